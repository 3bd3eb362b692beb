"""Language identification by held-out accuracy; the pipeline end to end."""
import random

from pyspark.sql import functions as F

from textquarry.llm import language as L

WORDS = {"en": "the of and this that with from have which their", "de": "der die und nicht mit sich auf eine auch werden", "fr": "le les des une dans pour que sur avec plus", "es": "el los las una con para que por como pero"}


def test_language(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(WORDS[g].split()) for _ in range(rng.randint(5, 40))), g) for k, g in ((k, rng.choice([*WORDS])) for k in range(400))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs, ~L.held_out())
    more = docs.unionByName(spark.createDataFrame([(1000, None, None), (1001, "12 !?", "en"), (None, "die und nicht mit", None)], docs.schema)).withColumn("score", F.lit(5))
    got = L.identify(more, model).withColumn("held", L.held_out()).collect()
    test = [r for r in got if r.held and r.doc_id < 1000]
    assert sum(r.language.lang == r.lang for r in test) / len(test) > 0.97
    by = {r.doc_id: r.language for r in got}
    assert by[1000] == by[1001] == ("und", 0.0) and by[None].lang == "de" and all(0 <= r.language.score <= 1 for r in got)
    kept = {r.doc_id for r in L.keep_identified(docs.unionByName(spark.createDataFrame([(1000, None, None)], docs.schema)), model).collect()}
    assert kept == set(range(400))
    none = L.fit(docs.limit(0), F.lit(True))
    assert {r.language.lang for r in L.identify(docs, none).collect()} == {"und"}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(2)
    text = lambda g, n: " ".join(rng.choice(WORDS[g].split()) + rng.choice("abcdef") for _ in range(n))
    rows = [(k, "\n".join(text(g, 30) for _ in range(3)), g, "s", 0) for k, g in ((k, rng.choice([*WORDS])) for k in range(80))]
    item = text("en", 20)
    rows += [(200, rows[0][1], "en", "s", 0), (201, None, "en", "s", 0), (202, "123", "en", "s", 0), (203, text("en", 40) + "\n" + item, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == before.columns, name
    left = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    assert set(range(80)) <= left and not {201, 202, 203} & left
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_near_dedup_keeps_rows_of_null_and_repeated_ids(spark):
    import corpus_pipeline

    rng = random.Random(9)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(1, a), (1, b), (None, c), (None, d), (2, e), (2, e), (3, e.upper()), (4, a + " more"), (None, e)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, __key long")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, a), (1, b), (None, c), (None, d), (2, e)], key=str)
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_found_languages_are_computed_once(spark):
    docs = spark.createDataFrame([(1, "the of and", "en"), (2, "der die und", "de")], "doc_id long, text string, lang string")
    plan = L.keep_identified(docs, L.fit(docs, F.lit(True)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
