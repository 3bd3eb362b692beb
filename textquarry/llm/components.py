"""Connected components of an edge table, by rounds of hooking and contraction."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of the edges (a, b) reaches.

    In a round every vertex hooks to its smallest neighbour, if that is smaller, and the edges are renamed by one such
    step; edges within a vertex vanish. Names only fall and the smallest of a component keeps its own, so when no edge is
    left, each node carries it. A round is a distributed aggregation and joins on narrow rows, stored in the shared
    folder; the number of rounds grows with the logarithm of the longest chain.
    """
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    labels = stored(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")))
    while not edges.isEmpty():
        hook = stored(edges.groupBy(F.col("b").alias("of")).agg(F.min("a").alias("to")))
        step = lambda df, c: df.join(hook.withColumnRenamed("of", c), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        labels = stored(step(labels, "component"))
        edges = step(step(edges, "a"), "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        edges = stored(edges.where("a < b").distinct())
    return labels
