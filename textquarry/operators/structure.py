"""Blocks, their classification and hierarchy.

Rows keep their order in explicit columns (block_seq, chunk_index). Classification, offsets, hierarchy and filters are
column expressions and windows by document; ``chunker`` has the steps that depend on state.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.text import nfkc, trimmed

MAX_CHARS = 1200

#: A count in Han or Arabic digits.
COUNT = r"[\d零〇一二两三四五六七八九十百千万]{1,9}"
# Level, rank, and the words that follow an ordinal (第 count word) at that level; a heading's words end there.
ORDINALS = (("part", 1, ("编", "篇", "部分", "部", "分"), True), ("chapter", 2, ("章",), True), ("section", 3, ("节",), True), ("article", 4, ("条",), False), ("paragraph", 5, ("款",), False))


def _ordinal_mark(words: tuple[str, ...], ends: bool) -> str:
    return rf"^(第\s*{COUNT}\s*(?:{'|'.join(words)}))" + (r"(?=\s|$)" if ends else "")


#: (level, rank, pattern whose first group is the mark): ordinals, then list marks in and without brackets, then attachments.
MARKERS = (
    *((level, rank, _ordinal_mark(words, ends)) for level, rank, words, ends in ORDINALS),
    ("item", 6, rf"^([(（]\s*{COUNT}\s*[)）])"),
    ("subitem", 7, rf"^({COUNT}[、.．])"),
    ("attachment", 1, rf"^(附[件录]\s*(?:{COUNT})?)"),
)
RANKS = {k: r for k, r, _ in MARKERS} | {"document": 0, "heading": 3, "table": 8, "text": 8}
HEADINGS = ("part", "attachment", "chapter", "section", "heading")


def blocks_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: bool = False) -> DataFrame:
    """(doc_id, block_seq, text): the lines of each document; ``normalise`` applies NFKC first."""
    x = nfkc(text_col) if normalise else F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(x, r"\n")).alias("block_seq", "text"))


def paragraphs(c: Column) -> Column:
    """Pieces between blank lines or before a Markdown heading."""
    return F.filter(F.transform(F.split(c, r"\n\s*\n|\n(?=#{1,6}\s)"), trimmed), lambda x: x != "")


def classify(c: Column, heading_chars: int = 36) -> Column:
    """struct(kind, marker): the first rule that holds, from tables to plain text."""
    x = F.trim(c)
    out = F.when(x.startswith("|"), F.struct(F.lit("table").alias("kind"), F.lit("").alias("marker")))
    out = out.when(x.rlike(r"\.{4,}|[…·]{6,}"), F.struct(F.lit("text").alias("kind"), F.lit("").alias("marker")))
    out = out.when(x.rlike(r"^\d+[.．]\d+"), F.struct(F.lit("subitem").alias("kind"), F.regexp_extract(x, r"^(\d+(?:[.．]\d+)+)", 1).alias("marker")))
    for kind, _, pattern in MARKERS:
        out = out.when(x.rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.regexp_replace(F.regexp_extract(x, pattern, 1), r"\s+", "").alias("marker")))
    short = (F.length(x) <= heading_chars) & (x != "") & ~x.rlike(r"[。！？；.!?;,，]$")
    return out.when(short, F.struct(F.lit("heading").alias("kind"), x.alias("marker"))).otherwise(F.struct(F.lit("text").alias("kind"), F.lit("").alias("marker")))


#: Java's $ also stands before a last line terminator.
_END = r"(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)"
_LEADERS, _NUMBERED, _NUMBER = (re.compile(p, re.A) for p in (r"\.{4,}|[…·]{6,}", r"\d+[.．]\d+", r"\d+(?:[.．]\d+)+"))
_MARKS = tuple((kind, re.compile(pattern.removeprefix("^").replace("$", _END), re.A)) for kind, _, pattern in MARKERS)
_STOP = re.compile(r"[。！？；.!?;,，]" + _END, re.A)
_BLANKS = re.compile(r"\s+", re.A)


def classified(line: str, heading_chars: int = 36) -> tuple[str, str]:
    """``classify`` of one line in Python, for steps that hold a document there: (kind, marker)."""
    x = line.strip(" ")
    if x.startswith("|"):
        return "table", ""
    if _LEADERS.search(x):
        return "text", ""
    if _NUMBERED.match(x):
        return "subitem", _NUMBER.match(x)[0]
    for kind, mark in _MARKS:
        if found := mark.match(x):
            return kind, _BLANKS.sub("", found[1])
    return ("heading", x) if 0 < len(x) <= heading_chars and not _STOP.search(x) else ("text", "")


def with_hierarchy(blocks: DataFrame) -> DataFrame:
    """kind, marker, and for each level the nearest heading above that no higher level has closed."""
    b = blocks.withColumn("c", classify(F.col("text"))).withColumn("kind", F.col("c.kind")).withColumn("marker", F.col("c.marker")).drop("c")
    until = Window.partitionBy("doc_id").orderBy("block_seq").rowsBetween(Window.unboundedPreceding, 0)
    scope = ["doc_id"]
    for level, rank in (("part", 1), ("chapter", 2), ("section", 3), ("article", 4)):
        own = [k for k, r in RANKS.items() if r == rank]
        inside = Window.partitionBy(*scope).orderBy("block_seq").rowsBetween(Window.unboundedPreceding, 0)
        b = b.withColumn(level, F.last(F.when(F.col("kind").isin(own), F.col("marker")), ignorenulls=True).over(inside))
        opened = F.sum(F.when(F.col("kind").isin(own), 1).otherwise(0)).over(until)
        b = b.withColumn(f"__{level}", opened)
        scope.append(f"__{level}")
    path = F.concat_ws(" / ", "part", "chapter", "section", "article")
    return b.withColumn("section_path", path).drop(*(c for c in scope if c.startswith("__")))


def offsets(blocks: DataFrame, separator: int = 2) -> DataFrame:
    """start_char and end_char in the document's clean text; blank blocks take their length but no separator."""
    before = Window.partitionBy("doc_id").orderBy("block_seq").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.length("text") + F.when(F.trim("text") == "", 0).otherwise(separator)
    b = blocks.withColumn("start_char", F.coalesce(F.sum(taken).over(before), F.lit(0)).cast("long"))
    return b.withColumn("end_char", F.col("start_char") + F.length("text"))


def without_toc(blocks: DataFrame, least: int = 3) -> DataFrame:
    """Leader-dot entries go from documents with ``least`` of them or a contents heading."""
    entry = F.col("text").rlike(r"(?:\.{2,}|…+|·{2,})\s*\d+\s*$")
    heading = F.trim(F.col("text")).rlike(r"^(?i:目\s*录|contents)$")
    whole = Window.partitionBy("doc_id")
    toc = (F.sum(entry.cast("int")).over(whole) >= least) | (F.max(heading.cast("int")).over(whole) == 1)
    return blocks.withColumn("__toc", toc & (entry | heading)).where(~F.col("__toc")).drop("__toc")


def _islands(b: DataFrame, goes_on: Column) -> DataFrame:
    until = Window.partitionBy("doc_id").orderBy("block_seq")
    return b.withColumn("island", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(until))


def merge_open_lines(blocks: DataFrame) -> DataFrame:
    """Joins a block that ends within a sentence with the next one that begins in lower case."""
    order = Window.partitionBy("doc_id").orderBy("block_seq")
    goes_on = F.lag("text").over(order).rlike(r"[^.!?。！？:：\s]\s*$") & F.col("text").rlike(r"^\p{Ll}")
    parts = F.array_sort(F.collect_list(F.struct("block_seq", "text")))
    return _islands(blocks, goes_on).groupBy("doc_id", "island").agg(F.min("block_seq").alias("block_seq"), F.count(F.lit(1)).alias("merged"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text")).drop("island")


def stitch_tables(blocks: DataFrame) -> DataFrame:
    """Joins adjacent table rows of one width into a table block."""
    width = F.size(F.split("text", r"\|"))
    b = blocks.withColumn("width", F.when(F.trim("text").startswith("|") | F.col("text").contains(" | "), width))
    order = Window.partitionBy("doc_id").orderBy("block_seq")
    goes_on = F.lag("width").over(order) == F.col("width")
    return _islands(b, goes_on).where("width is not null").groupBy("doc_id", "island", "width").agg(F.min("block_seq").alias("block_seq"), F.count(F.lit(1)).alias("rows")).drop("island")


def split_sentences(text: str, most: int = MAX_CHARS, delimiters: str = "。.!?！？；") -> list[str]:
    """A text in pieces of at most ``most`` characters at sentence ends, else at commas; one longer piece stays whole."""
    if len("".join(text.split())) <= most:
        return [text]
    for marks in (delimiters, "，,：:;；"):
        parts = [p for p in re.split(f"(?<=[{re.escape(marks)}])", text) if p.strip()]
        if len(parts) > 1:
            break
    out, size = [], 0
    for p in parts:
        n = len("".join(p.split()))
        if out and size + n <= most:
            out[-1] += p
            size += n
        else:
            out.append(p)
            size = n
    return out
