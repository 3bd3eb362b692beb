"""Incremental builds from content hashes."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plan(current: DataFrame, state: DataFrame, key: str = "document_id", hashes: tuple[str, ...] = ("hash", "version")) -> DataFrame:
    """(key, status): new, changed, reused or stale by the hash columns of the state."""
    c = current.select(F.col(key).alias("k"), *(F.col(h).alias(f"c_{h}") for h in hashes), F.lit(True).alias("c"))
    s = state.select(F.col(key).alias("s_k"), *(F.col(h).alias(f"s_{h}") for h in hashes), F.lit(True).alias("s"))
    same = F.lit(True)
    for h in hashes:
        same = same & F.col(f"c_{h}").eqNullSafe(F.col(f"s_{h}"))
    status = F.when(F.col("s").isNull(), "new").when(F.col("c").isNull(), "stale").when(same, "reused").otherwise("changed")
    return c.join(s, F.col("k") == F.col("s_k"), "full").select(F.coalesce("k", "s_k").alias(key), status.alias("status"))


def rebuild(current: DataFrame, state: DataFrame, build, key: str = "document_id", hashes: tuple[str, ...] = ("hash", "version")) -> DataFrame:
    """The new state: rows built for what is new or changed, kept for what is reused, none for what is stale."""
    todo = plan(current, state, key, hashes)
    fresh = build(current.join(todo.where("status in ('new', 'changed')"), key, "left_semi"))
    return state.join(todo.where("status = 'reused'"), key, "left_semi").unionByName(fresh)
