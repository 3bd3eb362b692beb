"""Sinks: JSON lines, CSV, Markdown, manifests, viewers; Spark's commit protocol makes each write all or nothing."""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.text import escape_markup


def write_json(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(partition_by) if partition_by else w).json(path)


def write_csv_index(chunks: DataFrame, path: str, preview: int = 200) -> None:
    """Flat columns and a preview of the text; quotes are doubled."""
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name) for f in chunks.schema if f.name != "text"]
    text = [F.regexp_replace(F.substring("text", 1, preview), r"\s+", " ").alias("preview")] if "text" in chunks.columns else []
    chunks.select(*flat, *text).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def csv_cell(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def document_markdown(chunks: DataFrame) -> DataFrame:
    """One Markdown text for each document, chunks in order."""
    part = F.struct("chunk_index", F.concat(F.lit("## "), F.col("chunk_index").cast("string"), F.lit("\n\n"), "body_text").alias("t"))
    parts = F.array_sort(F.collect_list(part))
    return chunks.groupBy("document_id").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n").alias("markdown"))


def structured_documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("block_count", F.size("blocks")).drop("blocks")


def manifest(df: DataFrame, key: str, **facts) -> DataFrame:
    """One row: counts, an order-independent fingerprint of the rows, and the given facts."""
    row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("documents"), F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("fingerprint")).select("*", *(F.lit(v).alias(k) for k, v in facts.items()))


def viewer_html(template: str, rows: DataFrame, placeholder: str = "__DATA__", most: int = 10_000) -> str:
    """A single page with the rows as JSON; a view for people, so more than ``most`` rows are an error."""
    if template.count(placeholder) != 1:
        raise ValueError("the placeholder must occur once")
    got = rows.select(escape_markup(F.to_json(F.struct("*"))).alias("j")).limit(most + 1).collect()
    if len(got) > most:
        raise ValueError("too many rows for one page")
    return template.replace(placeholder, json.dumps([json.loads(r["j"]) for r in got], ensure_ascii=False).replace("<", "\\u003c"))


def retained(log: DataFrame, days: int = 7, at: str = "timestamp") -> DataFrame:
    """Log rows of the last days."""
    return log.where(F.col(at) >= F.current_timestamp() - F.make_interval(days=F.lit(days)))


def redacted(c: Column, metadata_only: bool = False) -> Column:
    """A string map with secrets masked by key; in metadata mode long texts go too."""
    secret = lambda k: F.lower(k).rlike("api_?key|token|secret|password|authorization|cookie")
    text = lambda k: F.lower(k).rlike("prompt|content|message|answer|text")
    return F.transform_values(c, lambda k, v: F.when(secret(k), F.lit("[redacted]")).when(F.lit(metadata_only) & text(k), F.lit("[omitted]")).otherwise(v))
