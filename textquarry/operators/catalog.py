"""Catalogue joins: aliases by priority, unique fallbacks, fuzzy titles, and the corpus projection."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.metadata import title_similarity
from textquarry.functions.text import nz

from .retrieval import ranked

SIMILAR, MARGIN = 0.72, 0.03


def best_alias(aliases: DataFrame) -> DataFrame:
    """aliases (alias, id, priority, seq): one id for each alias, the highest priority and then the first."""
    return ranked(aliases.where(nz("alias") != ""), ["alias"], [F.col("priority").desc(), F.col("seq"), F.col("id")], 1, "k").select("alias", "id")


def join_by_aliases(rows: DataFrame, aliases: DataFrame, first: Column, second: Column) -> DataFrame:
    """``rows`` with catalogue_id by the first key, else by the second."""
    best = best_alias(aliases)
    one, two = best.select(F.col("alias").alias("__a"), F.col("id").alias("__1")), best.select(F.col("alias").alias("__b"), F.col("id").alias("__2"))
    met = rows.join(one, first == F.col("__a"), "left").join(two, second == F.col("__b"), "left")
    return met.withColumn("catalogue_id", F.coalesce("__1", "__2")).drop("__a", "__b", "__1", "__2")


def unique_match(rows: DataFrame, catalogue: DataFrame, key: Column, catalogue_key: Column, id_col: str) -> DataFrame:
    """``rows`` with the id of the only catalogue row of that key; several make a conflict."""
    c = catalogue.groupBy(catalogue_key.alias("__k")).agg(F.min(id_col).alias("__id"), F.count(F.lit(1)).alias("__n"))
    met = rows.join(c, key == F.col("__k"), "left")
    status = F.when(F.col("__n") == 1, "matched").when(F.col("__n") > 1, "conflict").otherwise("none")
    return met.withColumn("match_status", status).withColumn("match_id", F.when(F.col("__n") == 1, F.col("__id"))).drop("__k", "__id", "__n")


def _pairs_of(titles: DataFrame, side: str) -> DataFrame:
    """(id, title, length, gram): the pairs of characters, the k-th of equal ones numbered k, so that sets are multisets."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("title") - 1), lambda i: F.struct(F.substring("title", i, F.lit(2)).alias("g"), i.alias("i")))
    each = titles.where(F.length("title") >= 2).select(F.col("id").alias(f"{side}_id"), F.col("title").alias(side), F.inline(pairs))
    nth = F.row_number().over(Window.partitionBy(f"{side}_id", side, "g").orderBy("i"))
    return each.withColumn("gram", F.struct("g", nth.alias("k"))).drop("g", "i")


def similar_titles(left: DataFrame, right: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(left_id, right_id, similarity) of all pairs of titles (id, title) that reach ``least``, which must be above 2/3.

    A ratio r of titles of n and m characters means M >= r (n + m) / 2 characters in matching blocks. Between two blocks some
    character of either title is unmatched, so there are at most n + m - 2 M + 1 blocks, and a block of c characters holds
    c - 1 common pairs of characters: (3 r / 2 - 1) (n + m) - 1 common pairs at least. That many are asked for before a pair
    of titles is scored. Titles so short that they may share no pair share a character and meet on that.
    """
    if not least > 2 / 3:
        raise ValueError("least must be above 2/3")
    share = 1.5 * least - 1
    both = F.length("left") + F.length("right")
    fits = (F.length("right") * least <= F.length("left") * (2 - least)) & (F.length("left") * least <= F.length("right") * (2 - least))
    common = _pairs_of(left, "left").join(_pairs_of(right, "right"), "gram").where(fits).groupBy("left_id", "left", "right_id", "right").count()
    met = common.where(F.col("count") >= share * both - 1 - 1e-9).drop("count")
    most = int(1 / share)
    chars = lambda df, side: df.where(F.length("title") < most).select(F.col("id").alias(f"{side}_id"), F.col("title").alias(side), F.explode(F.array_distinct(F.split("title", ""))).alias("ch"))
    short = chars(left, "left").join(chars(right, "right"), "ch").where(fits & (both * share <= 1 + 1e-9)).drop("ch")
    scored = met.unionByName(short).distinct().withColumn("similarity", F.round(title_similarity("left", "right"), 6))
    return scored.where(F.col("similarity") >= least).select("left_id", "right_id", "similarity")


def fuzzy_titles(left: DataFrame, right: DataFrame, least: float = SIMILAR, margin: float = MARGIN) -> DataFrame:
    """(left_id, right_id, similarity): for each left title, in the order of the ids, its best right title that is still free.

    It must reach ``least`` and be ahead of the next free one by ``margin``. What is free depends on the titles before, but
    only on those that compete for the same ones: groups connected by pairs within reach are settled in an Arrow function each.
    """
    near = similar_titles(left, right, least - margin)
    group = near.select("left_id", F.col("left_id").alias("g")).distinct()
    while True:  # names of groups fall to the smallest id in reach
        spread = near.join(group, "left_id").groupBy("right_id").agg(F.min("g").alias("r"))
        after = near.join(spread, "right_id").groupBy("left_id").agg(F.min("r").alias("g"))
        after = after.checkpoint() if near.sparkSession.conf.get("spark.checkpoint.dir", None) else after
        if after.join(group.withColumnRenamed("g", "old"), "left_id").where("g <> old").isEmpty():
            break
        group = after

    def settle(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for lid, own in sorted(rows.groupby("left_id"), key=lambda x: x[0]):
            free = sorted((-s, r) for r, s in zip(own["right_id"], own["similarity"], strict=True) if r not in used)
            if free and -free[0][0] >= least and (len(free) == 1 or round(free[1][0] - free[0][0], 6) >= margin):
                used.add(free[0][1])
                out.append((lid, free[0][1], -free[0][0]))
        return pd.DataFrame(out, columns=["left_id", "right_id", "similarity"])

    kinds = {f.name: f.dataType.simpleString() for f in near.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("left_id", "right_id", "similarity"))
    return near.join(group, "left_id").groupBy("g").applyInPandas(settle, schema)


def gates(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys that are missing, unexpected or repeated in ``found``."""
    missing = expected.join(found, key, "left_anti").select(F.lit("missing").alias("gate"), key)
    extra = found.join(expected, key, "left_anti").select(F.lit("unexpected").alias("gate"), key)
    again = found.groupBy(key).count().where("count > 1").select(F.lit("duplicate").alias("gate"), key)
    return missing.unionByName(extra).unionByName(again)


def block_spans(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Span of each chunk's blocks in the document's text. chunks: chunk_id, doc_id, block_ids; blocks with offsets."""
    each = chunks.select("chunk_id", "doc_id", F.explode("block_ids").alias("block_seq"))
    return each.join(blocks.select("doc_id", "block_seq", "start_char", "end_char"), ["doc_id", "block_seq"]).groupBy("chunk_id").agg(F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"))


def coverage(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """Blocks of each document and how many some chunk covers."""
    held = chunks.select("doc_id", F.explode("block_ids").alias("block_seq")).distinct().withColumn("held", F.lit(1))
    return blocks.join(held, ["doc_id", "block_seq"], "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.count("held").alias("covered"))
