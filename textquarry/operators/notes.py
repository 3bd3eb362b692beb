"""A store of notes: scored search, dedup on normalised content, tags."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.text import compact, note_tokens, trimmed

from .retrieval import ranked

TAGS = 12


def content_key(c) -> Column:
    return F.sha2(F.lower(compact(c)), 256)


def search(queries: DataFrame, notes: DataFrame, limit: int = 4) -> DataFrame:
    """(query_id, note_id, score, rank): 3 for a query token in the title, 1 in the content, over sqrt(tokens).

    Only notes that share a token with a query are scored: tokens are joined, not notes with queries.
    """
    q = queries.select("query_id", note_tokens("text").alias("t")).withColumn("n", F.size("t"))
    token = lambda c, weight: notes.select("note_id", "updated_at", F.explode(note_tokens(c)).alias("token"), F.lit(weight).alias("w"))
    wanted = q.select("query_id", "n", F.explode("t").alias("token"))
    met = token("title", 3).unionByName(token("content", 1)).join(wanted, "token")
    scored = met.groupBy("query_id", "n", "note_id", "updated_at").agg(F.sum("w").alias("hits"))
    scored = scored.select("query_id", "note_id", "updated_at", F.round(F.col("hits") / F.sqrt(F.greatest("n", F.lit(1)).cast("double")), 6).alias("score"))
    return ranked(scored, ["query_id"], [F.col("score").desc(), F.col("updated_at").desc()], limit).drop("updated_at")


def first_of_each(notes: DataFrame) -> DataFrame:
    """The first note of each normalised content."""
    return notes.groupBy(content_key("content").alias("key")).agg(F.min("note_id").alias("note_id"))


def upsert(store: DataFrame, new: DataFrame) -> DataFrame:
    """store (key, note_id) with the new notes whose content it lacks."""
    added = first_of_each(new).join(store, "key", "left_anti").withColumn("status", F.lit("added"))
    return store.withColumn("status", F.lit("kept")).unionByName(added)


def tags(c: Column, most: int = TAGS) -> Column:
    return F.slice(F.array_distinct(F.filter(F.transform(c, trimmed), lambda t: t != "")), 1, most)


def by_ids(notes: DataFrame, ids: list) -> DataFrame:
    return notes.where(F.col("note_id").isin(ids))


def newest(notes: DataFrame) -> DataFrame:
    return notes.orderBy(F.col("updated_at").desc(), "note_id")
