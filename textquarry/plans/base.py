"""Registration of queries beside the SQL that must give their rows."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textquarry.sources.tables import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """The tables of a folder as attributes, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


class Catalogue:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, oracle: str | None = None, name: str | None = None):
        """Registers a function of Tables under its name, with its SQL."""

        def register(f: Callable[[Tables], DataFrame]):
            key = name or f.__name__
            self.queries[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if oracle:
                self.oracles[key] = oracle
            return f

        return register

    def sql(self, name: str, spark_sql: str, oracle: str | None = None) -> None:
        """A query written as SQL over the tables; ``oracle`` where the other engine's dialect differs."""

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            used = {t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in spark_sql}
            return spark.sql(spark_sql, **used)

        plain = spark_sql
        for t in TABLES:
            plain = plain.replace(f"{{{t}}}", t)
        self.queries[name] = run
        self.oracles[name] = oracle or plain
