"""Citation checks: quotes must stand in their sources word for word, or match one place up to formatting."""
from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from textquarry.session import bounded_batches

LEAST = 12


def canonical(text: str) -> tuple[str, list[int]]:
    """Lower-cased NFKC without spaces, marks and punctuation (kept between digits), and each character's place."""
    out, places = [], []
    for k, ch in enumerate(text):
        for c in unicodedata.normalize("NFKC", ch).lower():
            if c in ".,:":
                between = 0 < k < len(text) - 1 and text[k - 1].isdigit() and text[k + 1].isdigit()
                if not between:
                    continue
            elif not c.isalnum() and c != "%":
                continue
            out.append(c)
            places.append(k)
    return "".join(out), places


def align(source: str | None, quote: str | None, least: int = LEAST) -> tuple[str | None, str]:
    """(the source's own words, how): exact, aligned, too_short, ambiguous or missing."""
    if not source or not quote:
        return None, "missing"
    if quote in source:
        return quote, "exact"
    want, _ = canonical(quote)
    if len(want) < least:
        return None, "too_short"
    have, places = canonical(source)
    first = have.find(want)
    if first < 0:
        return None, "missing"
    if have.find(want, first + 1) >= 0:
        return None, "ambiguous"
    return source[places[first] : places[first + len(want) - 1] + 1], "aligned"


@F.pandas_udf(StructType([StructField("quote", StringType()), StructField("how", StringType())]))
def _aligned(source: pd.Series, quote: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([align(s, q) for s, q in zip(source, quote, strict=True)], columns=["quote", "how"])


def validate_citations(basis: DataFrame, hits: DataFrame) -> DataFrame:
    """basis (answer_id, evidence_id, quote) against hits (evidence_id, text): status and the source's own quote.

    A basis row with an unknown id or a quote that isn't there is an issue; repeated (id, quote) rows count once.
    """
    bounded_batches(basis.sparkSession)
    met = basis.dropDuplicates(["answer_id", "evidence_id", "quote"]).join(hits.select("evidence_id", "text", F.lit(True).alias("known")), "evidence_id", "left")
    found = met.withColumn("a", F.when(F.col("known") & F.contains("text", F.col("quote")), F.struct(F.col("quote"), F.lit("exact").alias("how"))).when(F.col("known"), _aligned("text", "quote")))
    status = F.when(F.col("known").isNull(), "unknown_id").otherwise(F.coalesce("a.how", F.lit("missing")))
    return found.select("answer_id", "evidence_id", status.alias("status"), F.col("a.quote").alias("source_quote"))


def answer_status(checked: DataFrame, answers: DataFrame) -> DataFrame:
    """answers (answer_id, insufficient): valid if every basis row is, and none only where evidence is insufficient."""
    bad = F.sum((~F.col("status").isin("exact", "aligned")).cast("int"))
    per = checked.groupBy("answer_id").agg(F.count(F.lit(1)).alias("basis"), bad.alias("issues"))
    met = answers.join(per, "answer_id", "left").fillna(0, ["basis", "issues"])
    valid = (F.col("issues") == 0) & ((F.col("basis") > 0) | F.col("insufficient"))
    return met.select("answer_id", "basis", "issues", valid.alias("valid"))
