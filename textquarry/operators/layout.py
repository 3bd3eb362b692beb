"""Lines and tables of paged sources: what a parser's raw lines need before they are blocks. No PDF library is used."""
from __future__ import annotations

import re
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_END = re.compile(r"[。.!?！？；;:：]\s*$")
_START = re.compile(r"^\s*(?:第\S{1,9}[编章节条款]|[（(]\s*[\d一二三四五六七八九十]{1,3}\s*[)）]|[\d一二三四五六七八九十]{1,3}[、.．]|附[件录]|\|)")
NORMATIVE, HEADING_CHARS = ("应当", "不得", "必须", "可以"), 36
FRONT_BLOCKS = 10
#: Where a table that goes on over pages must end and begin, as shares of the page's height.
BOTTOM, TOP = 0.72, 0.28


def is_guide_heading(line: str) -> bool:
    """A short Han line that ends no sentence, obliges nobody and isn't an item: the heading of a guide's section."""
    t = line.strip()
    return len(t) <= HEADING_CHARS and bool(re.search("[一-鿿]", t)) and not _END.search(t) and not any(w in t for w in NORMATIVE) and not re.search(r"[,，、]", t) and not _START.match(t)


def guide_heading(c: Column) -> Column:
    t = F.trim(c)
    return (F.length(t) <= HEADING_CHARS) & t.rlike("[一-鿿]") & ~t.rlike(r"[。.!?！？；;:：,，、]") & ~t.rlike("|".join(NORMATIVE)) & ~t.rlike(_START.pattern)


def joined_lines(lines: list[str]) -> list[str]:
    """Raw lines as paragraphs: a line goes on with the one before unless that ends a sentence, or it begins something.

    Latin words get a space between them, a hyphen at a line's end is closed up, and Han characters follow at once.
    """
    out: list[str] = []
    open_ = False
    for line in lines:
        t = line.strip()
        if not t:
            open_ = False
            continue
        if open_ and not _START.match(t) and not is_guide_heading(out[-1]):
            before = out[-1]
            if re.search(r"[a-z]-$", before) and t[:1].islower():
                out[-1] = before[:-1] + t
            else:
                out[-1] = before + (" " if before[-1:].isascii() and t[:1].isascii() else "") + t
        else:
            out.append(t)
        open_ = not _END.search(t)
    return out


def running_heads(pages: list[list[str]], edge: int = 2) -> set[str]:
    """Lines among the first or last ``edge`` of two pages (up to five), else of a third of the pages and three at least."""
    counts: dict[str, int] = {}
    for lines in pages:
        own = [x.strip() for x in lines if x.strip()]
        for t in {*own[:edge], *own[-edge:]}:
            counts[t] = counts.get(t, 0) + 1
    least = 2 if len(pages) <= 5 else max(3, ceil(len(pages) / 3))
    return {t for t, n in counts.items() if n >= least}


def normal_table(cells: list[list[str | None]]) -> list[list[str]] | None:
    """A table without blank rows and columns, white space made plain; None if it is prose in a frame: fewer than two columns
    or four cells that hold something."""
    rows = [[" ".join((c or "").split()) for c in r] for r in cells]
    width = max(map(len, rows), default=0)
    rows = [r + [""] * (width - len(r)) for r in rows if any(r)]
    kept = [k for k in range(width) if any(r[k] for r in rows)]
    rows = [[r[k] for k in kept] for r in rows]
    return rows if len(kept) >= 2 and sum(bool(c) for r in rows for c in r) >= 4 else None


def header_rows(rows: list[list[str]]) -> int:
    """Rows at the top without a number, before the first one with numbers; 1 where no row has any."""
    for k, r in enumerate(rows):
        if any(re.search(r"\d", c) for c in r):
            return max(1, k)
    return 1


def table_sentences(rows: list[list[str]]) -> list[str]:
    """A sentence a row, ``label：value；`` for each cell; several header rows are joined by `` / ``, a column without is 第n列."""
    head = header_rows(rows)
    labels = [" / ".join(dict.fromkeys(r[k] for r in rows[:head] if k < len(r) and r[k])) or f"第{k + 1}列" for k in range(max(map(len, rows), default=0))]
    return ["；".join(f"{labels[k]}：{c}" for k, c in enumerate(r) if c) for r in rows[head:] if any(r)]


def stitched(blocks: DataFrame) -> DataFrame:
    """Tables that go on over a page: next page, same width, the one ending low and the other beginning high.

    blocks: doc_id, block_seq, page, width, top, bottom (shares of the page's height). Adds part_of, the first block's number.
    """
    w = Window.partitionBy("doc_id").orderBy("block_seq")
    before = lambda c: F.lag(c).over(w)
    goes_on = (F.col("page") == before("page") + 1) & (F.col("width") == before("width")) & (before("bottom") >= BOTTOM) & (F.col("top") <= TOP)
    first = F.when(F.coalesce(goes_on, F.lit(False)), F.lit(None)).otherwise(F.col("block_seq"))
    marked = blocks.withColumn("__first", first)
    return marked.withColumn("part_of", F.last("__first", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__first")


def without_front_dates(blocks: DataFrame) -> DataFrame:
    """Blocks but for time stamps of printing among a document's first ``FRONT_BLOCKS``."""
    stamp = F.trim("text").rlike(r"^\d{4}[-/.年]\d{1,2}[-/.月]\d{1,2}日?(?:\s+\d{1,2}:\d{2}(?::\d{2})?)?$")
    return blocks.where(~((F.col("block_seq") < FRONT_BLOCKS) & stamp))


def missing_formula(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_seq) of lines that announce a formula which the next block doesn't hold."""
    w = Window.partitionBy("doc_id").orderBy("block_seq")
    says = F.trim("text").rlike(r"(?:公式如下|计算公式|formula|as follows)\s*(?:为|is)?\s*[:：]\s*$")
    held = F.coalesce(F.lead("text").over(w), F.lit("")).rlike(r"[=＝≤≥<>∑√×÷]")
    return blocks.withColumn("__m", says & ~held).where("__m").select("doc_id", "block_seq")
