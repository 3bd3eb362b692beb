"""Rule-based labels with located evidence. Rules are data: (dimension, rule_no, label, pattern, reason)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieval import ranked

MATCH_CAP, TITLE, EARLY, HEADING, THRESHOLD, EARLY_BLOCKS = 20, 50, 12, 20, 2, 15


def rule_scores(docs: DataFrame, rules: list[tuple[str, int, str, str, str]], title: str = "title", text: str = "text", head: str = "head", headings: str | None = None) -> DataFrame:
    """One row for each document and rule that matches: matches, score and whether it reaches the threshold.

    The rules are a fixed list, so they become expressions over one scan, not a join.
    """
    each = []
    for dimension, no, label, pattern, reason in rules:
        n = F.regexp_count(F.col(text), F.lit(pattern))
        in_title, early = F.col(title).rlike(pattern), F.col(head).rlike(pattern)
        score = F.least(n, F.lit(MATCH_CAP)) + F.when(in_title, TITLE).otherwise(0) + F.when(early, EARLY).otherwise(0)
        if headings:  # the text of the document's headings
            score = score + F.when(F.col(headings).rlike(pattern), HEADING).otherwise(0)
        each.append(F.when((n > 0) | in_title, F.struct(F.lit(dimension).alias("dimension"), F.lit(no).alias("rule_no"), F.lit(label).alias("label"), n.cast("long").alias("matches"), score.cast("long").alias("score"))))
    return docs.select("doc_id", F.inline(F.filter(F.array(*each), lambda x: x.isNotNull()))).where(F.col("score") >= THRESHOLD)


def top_labels(scores: DataFrame, cap: int) -> DataFrame:
    return ranked(scores, ["doc_id", "dimension"], [F.col("score").desc(), F.col("matches").desc(), F.col("rule_no").desc()], cap)


def first_evidence(blocks: DataFrame, rules: list[tuple[str, int, str, str, str]], titles: DataFrame | None = None) -> DataFrame:
    """The first block of a document that matches a rule, and the place of the match in it.

    With ``titles`` (doc_id, text) a title that matches comes before all blocks; its block_seq is -1.
    """
    if titles is not None:
        blocks = blocks.select("doc_id", "block_seq", "text").unionByName(titles.select("doc_id", F.lit(-1).alias("block_seq"), "text"))
    each = [F.when(F.col("text").rlike(p), F.struct(F.lit(d).alias("dimension"), F.lit(k).alias("rule_no"), F.regexp_instr("text", F.lit(p)).cast("long").alias("at"))) for d, k, _, p, _ in rules]
    found = blocks.select("doc_id", "block_seq", F.inline(F.filter(F.array(*each), lambda x: x.isNotNull())))
    return found.groupBy("doc_id", "dimension", "rule_no").agg(F.min(F.struct("block_seq", "at")).alias("m")).select("doc_id", "dimension", "rule_no", F.col("m.block_seq").cast("long").alias("block_seq"), F.col("m.at").alias("at"))


def with_defaults(docs: DataFrame, labels: DataFrame, dimensions: dict[str, str]) -> DataFrame:
    """Every document in every dimension; a default label where no rule holds."""
    wanted = docs.select("doc_id", F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.lit(x).alias("fallback")) for d, x in dimensions.items()))).alias("w")).select("doc_id", "w.*")
    return wanted.join(labels.select("doc_id", "dimension", "label"), ["doc_id", "dimension"], "left").select("doc_id", "dimension", F.coalesce("label", "fallback").alias("label"), F.col("label").isNull().alias("needs_review"))


def carried_labels(labels: DataFrame, baseline: DataFrame, dimensions: dict[str, str]) -> DataFrame:
    """(doc_id, dimension, label, level, needs_review): a rule's label is level A, one kept from the baseline B; the default
    label, where neither has one, is to be reviewed. baseline: doc_id, dimension, label."""
    docs = labels.select("doc_id").unionByName(baseline.select("doc_id")).distinct()
    wanted = docs.select("doc_id", F.inline(F.array(*(F.struct(F.lit(d).alias("dimension"), F.lit(x).alias("fallback")) for d, x in dimensions.items()))))
    by = ["doc_id", "dimension"]
    one = lambda df, c: df.groupBy(*by).agg(F.min("label").alias(c))
    met = wanted.join(one(labels, "own"), by, "left").join(one(baseline, "old"), by, "left")
    level = F.when(F.col("own").isNotNull(), "A").when(F.col("old").isNotNull(), "B").otherwise("")
    return met.select(*by, F.coalesce("own", "old", "fallback").alias("label"), level.alias("level"), (level == "").alias("needs_review"))
