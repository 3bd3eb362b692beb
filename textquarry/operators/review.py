"""The second look at chunks: positions and hashes, traces to the source, noise, and what neighbours settle.

Every check gives rows (check, severity, document_id, chunk_id), so ``quality.check_summary`` and ``review_status`` take them.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.metadata import ordered_coverage
from textquarry.functions.text import compact, nz

from .corpus import mismatches

TRACE_CHARS, TRACE_SHARE = 30, 0.95
#: name, severity and pattern of what a parser may leave in a body.
NOISE = (
    ("noise_replacement_character", "critical", "�"),
    ("noise_control_character", "critical", r"[\x00-\x08\x0B\x0C\x0E-\x1F]"),
    ("noise_field_code", "critical", r"(?i)\b(?:PAGEREF|MERGEFIELD|SEQ Table)\b"),
    ("noise_markup", "major", r"</?(?:p|div|span|table|tr|td)\b[^>]*>"),
    ("noise_leader_dots", "major", r"\.{6,}|…{3,}"),
    ("noise_blank_form", "major", "_{6,}"),
    ("noise_repeated_sign", "major", r"([!?*#=~-])\1{9,}"),
)


def _found(rows: DataFrame, check: str, severity: str) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), "document_id", "chunk_id")


def _marked(chunks: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """All rules in one pass over the chunks."""
    found = F.array(*(F.when(F.coalesce(p, F.lit(False)), F.struct(F.lit(c).alias("check"), F.lit(s).alias("severity"))) for c, s, p in rules))
    return chunks.select("document_id", "chunk_id", F.inline(F.array_compact(found))).select("check", "severity", "document_id", "chunk_id")


def noise(chunks: DataFrame) -> DataFrame:
    return _marked(chunks, [(name, severity, F.col("body_text").rlike(pattern)) for name, severity, pattern in NOISE])


def positions(chunks: DataFrame) -> DataFrame:
    """Chunks without a place in the clean text, without hashes, or whose overlap has none; columns: start_char, end_char,
    content_hash, overlap_source_chunk_id, overlap_start, overlap_end."""
    overlaps = nz("overlap_source_chunk_id") != ""
    return _marked(chunks, [
        ("clean_text_position", "major", F.col("start_char").isNull() | F.col("end_char").isNull() | (F.col("end_char") < F.col("start_char"))),
        ("incremental_hashes", "major", nz("content_hash") == ""),
        ("overlap_coordinates", "major", overlaps & (F.col("overlap_start").isNull() | F.col("overlap_end").isNull() | (F.col("overlap_end") < F.col("overlap_start")))),
    ])


def _neighbours(chunks: DataFrame) -> DataFrame:
    """Only the ends of the texts go through the windows."""
    w = Window.partitionBy("document_id").orderBy("chunk_index")
    ends = chunks.select("document_id", "chunk_id", "chunk_index", F.left("body_text", F.lit(80)).alias("head"), F.right(F.rtrim("body_text"), F.lit(80)).alias("tail"))
    return ends.withColumns({"before": F.lag("tail").over(w), "after": F.lead("head").over(w)})


ITEM = r"^\s*(?:[（(]\s*[\d一二三四五六七八九十]{1,3}\s*[)）]|[\d一二三四五六七八九十]{1,3}[、.．])"


def split_enumerations(chunks: DataFrame) -> DataFrame:
    """Chunks that end within a list which the next one goes on with: the end is a semicolon or comma, the next an item."""
    n = _neighbours(chunks)
    return _found(n.where(F.col("tail").rlike("[;；,，]$") & F.col("after").rlike(ITEM)), "possible_split_enumeration", "minor")


def unknown_sources(chunks: DataFrame, documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """Chunks of no stored document, and chunks that name a block (block_ids) which their document doesn't have."""
    lost = chunks.join(documents.select("document_id"), "document_id", "left_anti")
    named = chunks.join(documents.select("document_id"), "document_id", "left_semi").select("document_id", "chunk_id", F.explode("block_ids").alias("block_seq"))
    absent = named.join(blocks.select("document_id", "block_seq"), ["document_id", "block_seq"], "left_anti").select("document_id", "chunk_id").distinct()
    return _found(lost, "missing_structured_document", "critical").unionByName(_found(absent, "missing_source_block", "critical"))


def untraceable(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks of ``TRACE_CHARS`` characters or more of which less than ``TRACE_SHARE`` stands in the source (chunk_id, source) in order.

    Bodies that stand in it as they are need no alignment.
    """
    met = chunks.select("document_id", "chunk_id", compact("body_text").alias("b")).where(F.length("b") >= TRACE_CHARS).join(sources.select("chunk_id", compact("source").alias("s")), "chunk_id")
    return _found(met.where(~F.contains("s", F.col("b"))).where(ordered_coverage("b", "s") < TRACE_SHARE), "body_not_traceable", "major")


def wrong_metadata(chunks: DataFrame, catalogue: DataFrame, fields: tuple[str, ...], path: str = "file_path") -> DataFrame:
    """Chunks whose metadata differ from those of their document's catalogue row (document_id)."""
    own = chunks.select("document_id", "chunk_id", *fields, path)
    met = mismatches(own.select("chunk_id", *fields, path), own.select("chunk_id", "document_id").join(catalogue, "document_id").drop("document_id"), "chunk_id", (*fields, path))
    found = met.join(own.select("chunk_id", "document_id"), "chunk_id")
    at = F.col("field") == path
    return found.select(F.when(at, "file_path_mismatch").otherwise("metadata_mismatch").alias("check"), F.when(at, "critical").otherwise("major").alias("severity"), "document_id", "chunk_id").distinct()


def repeated_bodies(chunks: DataFrame, least: int = 50) -> DataFrame:
    """A body that stands twice in one document; other documents may share it."""
    k = chunks.select("document_id", "chunk_id", "chunk_index", F.length(compact("body_text")).alias("n"), F.sha2(compact("body_text"), 256).alias("h")).where(F.col("n") >= least)
    again = k.withColumn("k", F.row_number().over(Window.partitionBy("document_id", "h").orderBy("chunk_index"))).where("k > 1")
    return _found(again, "duplicate_in_document", "minor")


def resolved(issues: DataFrame, chunks: DataFrame) -> DataFrame:
    """``issues`` with ``resolution``: what the neighbours show to be no fault; '' leaves an issue open.

    A short chunk or a lone item is fine between others of a list, and a split list where the next chunk takes the item up.
    """
    n = _neighbours(chunks).select("chunk_id", "head", "tail", "before", "after")
    met = issues.join(n, "chunk_id", "left")
    in_list = F.col("head").rlike(ITEM) & (F.col("before").rlike("[;；:：]$") | F.col("after").rlike(ITEM))
    goes_on = F.col("tail").rlike("[;；:：,，]$") & F.col("after").rlike(ITEM)
    how = F.when(F.col("check").isin("orphan_list_item", "very_short_chunk") & in_list, "part of a list").when(F.col("check").isin("incomplete_enumeration", "possible_split_enumeration") & goes_on, "goes on in the next chunk").otherwise("")
    return met.select(*issues.columns, F.coalesce(how, F.lit("")).alias("resolution"))


def all_checks(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)
