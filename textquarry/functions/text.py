"""Column functions: normalisation, keys, tokens, hashes, numbers and small parsers.

NFKC has no Spark built-in; ``nfkc`` is the one Arrow UDF here and skips text that is ASCII already. The others are
built-in expressions, so they stay inside code generation and can be pushed to a scan.
"""
from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UNIT = "\x1f"
LATIN_TOKEN = r"[a-z0-9]+(?:[._/-][a-z0-9]+)*"
HAN_RUN = r"\p{IsHan}+"
#: Unicode's space separators.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKC", v))


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nz(*cs) -> Column:
    """First value that is neither null nor ''."""
    return F.coalesce(*(F.nullif(col(c), F.lit("")) for c in cs), F.lit(""))


def trimmed(c) -> Column:
    """Without space separators at either end. Of one argument: ``F.transform`` would give F.trim the index as what to trim."""
    return F.trim(col(c), F.lit(SPACES))


def clean(c) -> Column:
    """Line ends, control characters, runs of blanks, spaces at line starts, at most one empty line, trimmed."""
    x = F.regexp_replace(col(c), r"\r\n?", "\n")
    x = F.regexp_replace(x, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    x = F.regexp_replace(x, r"(\d)\.\n(\d)", "$1.$2")
    x = F.regexp_replace(x, r"[ \t\x{3000}]+", " ")
    x = F.regexp_replace(x, r"\n +", "\n")
    return F.regexp_replace(F.regexp_replace(x, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def compact(c) -> Column:
    return F.regexp_replace(col(c), r"(?U)\s+", "")


def body_chars(c) -> Column:
    return F.length(compact(c))


def stable_id(*parts, length: int = 16) -> Column:
    """Prefix of the SHA-256 of the parts, joined by U+001F."""
    return F.substring(F.sha2(F.concat_ws(UNIT, *(F.coalesce(col(p).cast("string"), F.lit("")) for p in parts)), 256), 1, length)


def title_key(c, kind: str = "retrieval") -> Column:
    """Comparison keys of titles. kind: compact, cover, retrieval, amended, viewer or url; each is a different key."""
    x = col(c)
    no_space = lambda v: F.regexp_replace(v, r"(?U)\s+", "")
    if kind == "compact":
        return F.regexp_replace(F.regexp_replace(x, r"(?U)[\s《》()（）\[\]【】_-]", ""), "(?:附件|修订稿|草案)$", "")
    if kind == "cover":
        return F.regexp_replace(no_space(x), r"[《》〈〉<>“”\"'（）()]", "")
    if kind == "amended":
        x = F.regexp_replace(no_space(x), r"[（(]?\d{4}年?(修订|修正)?[)）]?$", "")
        return F.replace(x, F.lit("修订"), F.lit("修正"))
    if kind == "viewer":
        return F.lower(F.regexp_replace(no_space(x), r"[^\p{IsHan}\p{L}\p{N}]", ""))
    if kind == "url":
        return F.lower(no_space(x))
    x = F.regexp_replace(x, r"(?i)\.(pdf|docx?|xlsx?|txt|md|html)$", "")
    return F.lower(F.regexp_replace(x, r"""(?U)[\s·•・“”‘’"'《》<>【】\[\],，.。;；:：!！?？]""", ""))


def han_pairs(c) -> Column:
    """Overlapping pairs of each run of Han characters; a single one by itself."""
    pairs = lambda run: F.when(F.length(run) == 1, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2))))
    return F.flatten(F.transform(F.regexp_extract_all(col(c), F.lit(HAN_RUN), F.lit(0)), pairs))


def tokens(c, terms: tuple[str, ...] = ()) -> Column:
    """Latin words, overlapping pairs of Han runs, and ``term:`` tokens of a dictionary, repeats kept."""
    x = F.lower(col(c))
    latin = F.regexp_extract_all(x, F.lit(LATIN_TOKEN), F.lit(0))
    parts = [latin, han_pairs(x)]
    if terms:
        known = F.array(*(F.lit(t.lower()) for t in terms))
        parts.append(F.transform(F.filter(known, lambda t: F.contains(x, t)), lambda t: F.concat(F.lit("term:"), t)))
    return F.concat(*parts)


def note_tokens(c) -> Column:
    """Set of words and of one to three Han characters across gaps, for the notes store."""
    x = F.lower(col(c))
    han = F.array_join(F.regexp_extract_all(x, F.lit(HAN_RUN), F.lit(0)), "")
    grams = [F.when(F.length(han) >= n, F.transform(F.sequence(F.lit(1), F.length(han) - (n - 1)), lambda i, n=n: F.substring(han, i, F.lit(n)))).otherwise(F.array().cast("array<string>")) for n in (1, 2, 3)]
    return F.array_distinct(F.concat(F.regexp_extract_all(x, F.lit(r"[a-z0-9.%]+"), F.lit(0)), *grams))


def is_page_number(c) -> Column:
    return F.trim(col(c)).rlike(r"(?i)^(?:-?\s*\d+\s*-?|\d+\s*/\s*\d+|[ivxlcdm]{1,8}|第\s*\d+\s*页(?:\s*共\s*\d+\s*页)?)$")


def is_toc_field(c) -> Column:
    return col(c).rlike(r"(?i)TOC\s*\\|PAGEREF|HYPERLINK\s*\\l")


def iso_date(c) -> Column:
    """YYYY年M月D日 or Y-M-D as YYYY-MM-DD, else ''."""
    part = lambda k: F.regexp_extract(col(c), r"(\d{4})\s*[年./-]\s*(\d{1,2})\s*[月./-]\s*(\d{1,2})\s*日?", k)
    return F.when(part(1) != "", F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))).otherwise("")


def sentences(c, delimiters: str = ".!?") -> Column:
    """Pieces that end with their delimiter, without empty ones."""
    kept = F.split(col(c), f"(?<=[{re.escape(delimiters)}])")
    return F.filter(F.transform(kept, trimmed), lambda s: s != "")


def markdown_row(cells: Column) -> Column:
    cell = lambda v: F.replace(F.replace(F.coalesce(v, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, cell), " | "), F.lit(" |"))


def markdown_table(rows: Column) -> Column:
    """array<array<string>> as a Markdown table; short rows are padded."""
    width = F.array_max(F.transform(rows, F.size))
    padded = F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    lines = F.transform(padded, markdown_row)
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")


def markdown_grid(c) -> Column:
    """Cells of a Markdown table's rows, rules left out."""
    lines = F.filter(F.split(col(c), "\n"), lambda x: F.trim(x).startswith("|") & ~F.trim(x).rlike(r"^\|(?:\s*:?-{2,}:?\s*\|)+$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"(?<!\\)\|"), trimmed))


def table_sentences(headers: Column, row: Column) -> Column:
    """``label：value`` of the filled cells of a row, joined by ；."""
    named = F.zip_with(headers, row, lambda h, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.coalesce(h, F.lit("")), F.lit("："), v)))
    return F.array_join(F.filter(named, lambda x: x.isNotNull()), "；")


def literal_overlap(left, right, limit: int = 480) -> Column:
    """Longest suffix of left that is a prefix of right, up to ``limit`` characters."""
    most = F.least(F.lit(limit), F.length(col(left)), F.length(col(right)))
    sizes = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.array_max(F.filter(sizes, lambda n: F.right(col(left), n) == F.left(col(right), n))), F.lit(0))


def containment(left, right) -> Column:
    """Ratio of the lengths where one whitespace-free text holds the other, else 0."""
    a, b = compact(left), compact(right)
    holds = (F.length(a) > 0) & (F.length(b) > 0) & (F.contains(a, b) | F.contains(b, a))
    return F.when(holds, F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))).otherwise(F.lit(0.0))


def bigrams(c) -> Column:
    x = col(c)
    return F.when(F.length(x) >= 2, F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def bigram_share(expected, actual) -> Column:
    """Share of the expected text's pairs of characters that the actual text has."""
    want = bigrams(expected)
    return F.when(F.size(want) == 0, F.lit(0.0)).otherwise(F.size(F.filter(want, lambda b: F.contains(col(actual), b))) / F.size(want))


def valid_url(c) -> Column:
    return col(c).rlike(r"(?i)^https?://[^\s/?#]+")


def excerpt(c, at, limit: int = 120) -> Column:
    """Characters around place ``at`` (from 1) of the whitespace-collapsed text, with ellipses where it is cut."""
    x = F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))
    first = F.greatest(F.lit(1), col(at) - limit // 2)
    return F.concat(F.when(first > 1, F.lit("…")).otherwise(""), F.substring(x, first, F.lit(limit)), F.when(first + limit <= F.length(x), F.lit("…")).otherwise(""))


def conversation_title(c, limit: int = 28) -> Column:
    x = F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))
    return F.when(F.length(x) > limit, F.concat(F.left(x, F.lit(limit)), F.lit("…"))).otherwise(x)


def duration(ms) -> Column:
    return F.when(col(ms) < 1000, F.concat(col(ms).cast("string"), F.lit("ms"))).otherwise(F.concat(F.format_number(col(ms) / 1000, 1), F.lit("s")))


def validity_class(c) -> Column:
    """Buckets of a validity remark; the labels are fixed values."""
    x = F.trim(F.coalesce(col(c), F.lit("")))
    pending = F.contains(x, F.lit("已公布")) & F.contains(x, F.lit("尚未施行"))
    out = F.when(x.startswith("现行使用"), "现行使用（官网仍列示）").when(pending, "已公布、尚未施行").when(x.startswith("现行有效"), "现行有效")
    return out.when(x == "", "状态未载").otherwise(x)


def article_label(start, end) -> Column:
    a, b = nz(start), nz(end)
    return F.when((b == "") | (a == b), a).when(a == "", b).otherwise(F.concat(a, F.lit("至"), b))


def json_object(c) -> Column:
    """From the first { to the last }."""
    return F.regexp_extract(col(c), r"(?s)\{.*\}", 0)


def escape_markup(c) -> Column:
    x = F.replace(col(c), F.lit("&"), F.lit("\\u0026"))
    return F.replace(F.replace(x, F.lit("<"), F.lit("\\u003c")), F.lit(">"), F.lit("\\u003e"))


# Chinese digits, and units below and from ten thousand.
HAN_DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
HAN_SMALL = {"十": 10, "百": 100, "千": 1000}
HAN_LARGE = {"万": 10_000, "亿": 100_000_000}


def han_number(c) -> Column:
    """Value of an Arabic or Chinese whole number (with 十, 百, 千, 万, 亿), null if it isn't one."""
    x = F.trim(col(c))
    table = lambda d: F.create_map(*(F.lit(v) for kv in d.items() for v in kv))
    digit, small, large = table(HAN_DIGITS), table(HAN_SMALL), table(HAN_LARGE)
    zero = F.struct(*(F.lit(0).cast("long").alias(n) for n in ("total", "part", "num")))

    def step(s, ch):
        num = F.coalesce(F.element_at(digit, ch), F.lit(-1)).cast("long")
        by = F.element_at(small, ch).cast("long")
        big = F.element_at(large, ch).cast("long")
        st = lambda t, p, n: F.struct(t.cast("long").alias("total"), p.cast("long").alias("part"), n.cast("long").alias("num"))
        none = F.lit(0)
        return (
            F.when(num >= 0, st(s["total"], s["part"], num))
            .when(by.isNotNull(), st(s["total"], s["part"] + F.when(s["num"] == 0, F.lit(1)).otherwise(s["num"]) * by, none))
            .when(big.isNotNull(), st(s["total"] + (s["part"] + s["num"]) * big, none, none))
            .otherwise(s)
        )

    folded = F.aggregate(F.split(x, ""), zero, step, lambda s: s["total"] + s["part"] + s["num"])
    return F.when(x.rlike(r"^\d{1,18}$"), x.cast("long")).when(x.rlike(f"^[{''.join([*HAN_DIGITS, *HAN_SMALL, *HAN_LARGE])}]+$"), folded)


def latin_lead(c) -> Column:
    """First line, trimmed: stands for a title where a table has none."""
    return F.trim(F.regexp_extract(col(c), r"^([^\n]*)", 1))
