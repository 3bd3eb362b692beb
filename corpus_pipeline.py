"""A corpus pipeline out of five operators; each stage's rows are written and read again as the next one's documents."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import language
from textquarry.llm.common import fresh, stored, table
from textquarry.llm.decontaminate import decontaminate
from textquarry.llm.lines import dedup_lines
from textquarry.llm.near import near_groups
from textquarry.llm.packing import pack_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; lang becomes the one found."""
    return language.keep_identified(docs, language.fit(docs, F.lit(True)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an equal line precedes go, and those of five words or more that a near one precedes; no row goes."""
    return dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near texts stays: that with the smallest doc_id, then the smallest hash.

    Near are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, see ``near_groups``. Rows are told
    apart by doc_id and text, so null and repeated doc_ids join nothing; a null doc_id comes after all others.
    """
    key = fresh(docs, "__key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = near_groups(keyed, key)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.col(key).alias("key"))
    first = found.join(keyed.select(key, "doc_id").distinct(), key).groupBy("component_id").agg(F.min(order).alias("first"))
    met = keyed.join(first.select(F.col("first.key").alias(key)), key, "left_semi")
    # Only rows that come more than once are gathered by their key with all they hold.
    again = keyed.groupBy(key).count().where("count > 1").select(key)
    one = met.join(again, key, "left_semi").groupBy(key).agg(F.min(F.struct(docs.columns)).alias("row")).select("row.*")
    return met.join(again, key, "left_anti").select(docs.columns).unionByName(one)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; the others lose their hit spans."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents left, with their ids: what a trainer reads."""
    return pack_documents(docs, with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", packing),
]
#: No SQL: the classifiers, SimHash components and the tokenizer are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
