"""Data-quality rules over chunks, each a small DataFrame of issues, and their union.

A row rule is a predicate, and all row rules are evaluated in one pass over the chunks; rules about neighbours and groups
are windows and aggregations. chunk columns: chunk_id, document_id, chunk_index, body_text, text, title, character_count,
is_oversized, overlap_source_chunk_id.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.text import compact

MAX_CHARS, END_CHARS = 1200, 200
SEVERITIES = ("critical", "major", "minor")
HEADING_LINE = r"^(?:第.{1,12}[编篇章节部分].{0,60}|附件.{0,60}|#{1,6} .*)$"
PAGE_LINE = r"(?i)^\s*(?:-\s*\d+\s*-|\d+\s*/\s*\d+|第\s*\d+\s*页)\s*$"


def row_rules(most: int = MAX_CHARS) -> list[tuple[str, str, Column]]:
    """(check, severity, predicate); an empty chunk is reported as such only."""
    body, n = F.col("body_text"), F.length(compact("body_text"))
    full = n > 0
    lines = F.filter(F.split(body, "\n"), lambda x: F.trim(x) != "")
    return [
        ("empty_chunk", "critical", ~full | body.isNull()),
        ("character_limit", "critical", full & (n > most) & ~F.col("is_oversized")),
        ("marked_oversized", "minor", full & F.col("is_oversized")),
        ("title_context", "major", full & (F.coalesce("title", F.lit("")) != "") & ~F.contains(F.substring("text", 1, 600), F.col("title"))),
        ("private_use_character", "critical", full & body.rlike(r"[\x{E000}-\x{F8FF}]")),
        ("unmapped_character", "major", full & F.contains(body, F.lit("�"))),
        ("word_field_code", "critical", full & body.rlike(r"(?i)TOC\s*\\|PAGEREF|HYPERLINK\s*\\l")),
        ("table_of_contents_residue", "critical", full & (F.regexp_count(body, F.lit(r"(?:\.{4,}|…{2,})\s*\d+")) >= 2)),
        ("heading_only_chunk", "major", full & F.forall(lines, lambda x: x.rlike(HEADING_LINE))),
        ("very_short_chunk", "minor", full & (n < 80)),
        ("orphan_list_item", "minor", full & (n < 80) & body.rlike(r"^\s*(?:[（(]\d+[）)]|\d+[.、])")),
        ("page_number_residue", "major", full & F.exists(lines, lambda x: x.rlike(PAGE_LINE))),
    ]


def _row_issues(chunks: DataFrame, most: int) -> DataFrame:
    found = F.array(*(F.when(F.coalesce(p, F.lit(False)), F.struct(F.lit(c).alias("check"), F.lit(s).alias("severity"))) for c, s, p in row_rules(most)))
    return chunks.select("document_id", "chunk_id", F.inline(F.filter(found, lambda x: x.isNotNull()))).select("check", "severity", "document_id", "chunk_id")


def _issue(df: DataFrame, check: str, severity: str) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), "document_id", "chunk_id")


def all_issues(chunks: DataFrame, documents: DataFrame | None = None, most: int = MAX_CHARS) -> DataFrame:
    """(check, severity, document_id, chunk_id) of every rule; documents: document_id of what should have chunks."""
    order = Window.partitionBy("document_id").orderBy("chunk_index")
    by_doc = Window.partitionBy("document_id")
    parts = [_row_issues(chunks, most)]
    repeated = chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.min("document_id").alias("document_id")).where("n > 1")
    parts.append(_issue(repeated, "chunk_id_unique", "critical"))
    key = chunks.where(F.coalesce("overlap_source_chunk_id", F.lit("")) == "").select("document_id", "chunk_id", "chunk_index", compact("body_text").alias("k"))
    key = key.select("document_id", "chunk_id", "chunk_index", F.length("k").alias("n"), F.sha2("k", 256).alias("h")).where("n >= 50")
    again = key.withColumn("k", F.row_number().over(Window.partitionBy("document_id", "h").orderBy("chunk_index"))).where("k > 1")
    parts.append(_issue(again, "duplicate_chunk_body", "major"))
    parts.append(_issue(chunks.withColumn("k", F.row_number().over(order)).where("k <> chunk_index"), "chunk_order", "critical"))
    source = chunks.select(F.col("chunk_id").alias("source_id"), F.col("document_id").alias("source_doc")).distinct()
    traced = chunks.where(F.coalesce("overlap_source_chunk_id", F.lit("")) != "").join(source, (F.col("overlap_source_chunk_id") == F.col("source_id")) & (F.col("document_id") == F.col("source_doc")), "left_anti")
    parts.append(_issue(traced, "overlap_trace", "major"))
    # Only the ends of the texts go through the window; more white space than that counts as text.
    ends = chunks.select("document_id", "chunk_id", "chunk_index", F.right("body_text", F.lit(END_CHARS)).alias("tail"), F.left("body_text", F.lit(END_CHARS)).alias("head"))
    opens = ends.withColumn("after", F.lead("head").over(order)).where(F.col("tail").rlike(r"[:：]\s*$") & F.col("after").rlike(r"^\s*(?:[（(]\S{1,3}[）)]|\d+[.、])"))
    parts.append(_issue(opens, "incomplete_enumeration", "major"))
    if "file_name" in chunks.columns:
        mixed = chunks.groupBy("document_id").agg(F.countDistinct("file_name").alias("n"), F.min("chunk_id").alias("chunk_id")).where("n > 1")
        parts.append(_issue(mixed, "file_isolation", "critical"))
    if {"article_start", "article_end"} <= set(chunks.columns):
        parts.append(_issue(chunks.where("article_end < article_start"), "article_range", "major"))
        before = chunks.withColumn("p", F.max("article_start").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        parts.append(_issue(before.where("article_start < p"), "article_order", "major"))
        gap = chunks.withColumn("p", F.lag("article_end").over(order)).withColumn("n", F.count("article_start").over(by_doc))
        parts.append(_issue(gap.where("n >= 10 and article_start > p + 1"), "article_sequence_gap", "major"))
        start = chunks.withColumn("k", F.row_number().over(order)).withColumn("n", F.count("article_start").over(by_doc))
        parts.append(_issue(start.where("n >= 10 and k = 1 and article_start > 2"), "article_start_gap", "major"))
    if documents is not None:
        parts.append(_issue(documents.join(chunks, "document_id", "left_anti").withColumn("chunk_id", F.lit(None).cast(dict(chunks.dtypes)["chunk_id"])), "empty_document_output", "critical"))
    return reduce(DataFrame.unionByName, parts)


def check_summary(issues: DataFrame) -> DataFrame:
    """A check passes if it has no critical or major issue."""
    hard = F.col("severity").isin("critical", "major")
    return issues.groupBy("check").agg(F.count(F.lit(1)).alias("issues"), (F.sum(hard.cast("int")) == 0).alias("passed"))


def review_status(chunks: DataFrame, issues: DataFrame) -> DataFrame:
    """Per chunk: the worst severity decides between pass, needs_manual_review and needs_fix."""
    rank = F.when(F.col("severity") == "critical", 3).when(F.col("severity") == "major", 2).otherwise(1)
    worst = issues.where("chunk_id is not null").groupBy("chunk_id").agg(F.max(rank).alias("worst"), F.count(F.lit(1)).alias("issues"))
    status = F.when(F.col("worst") == 3, "needs_fix").when(F.col("worst") == 2, "needs_manual_review").otherwise("pass")
    return chunks.select("chunk_id", "document_id").join(worst, "chunk_id", "left").select("chunk_id", "document_id", status.alias("status"), F.coalesce("issues", F.lit(0)).cast("long").alias("issues"))
