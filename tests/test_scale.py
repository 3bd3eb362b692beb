"""What tasks hold and what is dealt out, where texts are long or many."""
import random

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from textquarry.operators import front_matter as M
from textquarry.operators import structure
from textquarry.plans import library
from textquarry.sources import files


def test_pages_come_in_batches_of_bounded_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.unset(name)
    try:
        rows = F.pandas_udf(lambda s: pd.Series([len(s)] * len(s)), IntegerType())
        pages = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("<p>a"), 2500).alias("html"))
        files.html_text_nodes("html")
        assert pages.select(rows("html").alias("n")).agg(F.max("n")).first()[0] * 10_000 <= 2 * (8 << 20)
        assert {r.n for r in pages.select(F.md5(files.html_text_nodes("html")).alias("n")).distinct().collect()} == {spark.range(1).select(F.md5(F.array_join(F.array_repeat(F.lit("a"), 2500), "\n"))).first()[0]}
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def test_fingerprint_gate_deals_digests(spark, tmp_path):
    spark.createDataFrame([(k, f"s{k % 2}", "x" * 5000) for k in range(40)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = library.C.queries["r9_fingerprint_gate"](spark, str(tmp_path))
    dealt = got._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1]
    assert "sha2" in dealt and "], 7" not in dealt and got.first().asDict() == {"rows": 40, "same": True}


def test_front_matter_deals_marks_not_texts(spark):
    rng = random.Random(2)
    pool = ["标题办法", "第一条 甲", "3.1 乙", "(2) 丙", "二、丁", "〇、戊", "附件1", "HTTP://a.b/c", "2020年3月", "〔2020〕第5号", "某会公告", "现予公布《标题办法》。", "（2020年发布）", "根据2020年决定修订", "主席 张三", "plain text", "", "5 號", "http"]
    docs = spark.createDataFrame([(k, "\n".join(rng.choices(pool, k=30)), "标题办法") for k in range(60)], "doc_id long, text string, document_title string")
    blocks = docs.select("doc_id", "document_title", F.posexplode(F.split("text", "\n")).alias("block_seq", "text"))
    judged = M.judge(blocks).select("doc_id", "block_seq", "rule_id")
    sorts = [line for line in judged._jdf.queryExecution().executedPlan().toString().split("\n") if "Sort [" in line]
    assert len(sorts) == 1
    x = F.trim("text")
    fits = [x.rlike(p) for p in (M.STRUCTURE, M.URL, M.NUMBER_HEAD, M.NUMBER_TAIL, M.NUMBER_LINE, M.ATTACHMENT, M.MONTH, M.DATE, M.OFFICER)] + [M.is_wrapper(x), M.is_promulgation(x), M.is_revision(x)]
    for p in fits:
        assert structure.blocks_of(docs).where(p & ~x.rlike(M.MAY)).count() == 0
