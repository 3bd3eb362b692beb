"""Stages of the pipeline on small made-up rows."""
import random

import corpus_pipeline as P
from textquarry.llm import near as N
from textquarry.llm.lines import op8_line_dedup


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_near_dedup_rows_without_usable_ids(spark):
    rng = random.Random(5)
    a, b, c, d, e = (" ".join(words(rng, 80)) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (3, d), (9, e), (9, e), (None, e), (None, None), (4, "")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in P.near_dedup(spark, docs, "").collect()), key=str)
    assert got == sorted([(None, a), (None, b), (7, c), (3, d), (9, e), (4, "")], key=str)
    assert P.near_dedup(spark, docs.limit(0), "").count() == 0


def test_near_dedup_finds_similarity_of_four_fifths(spark):
    rng = random.Random(6)
    rows, same = [], 0
    for k in range(150):
        a = words(rng, rng.randint(60, 400))
        b = list(a)
        for _ in range(max(1, len(a) // 70)):
            b[rng.randrange(len(b))] = "changed"
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    sets = {i: N.shingles(t) for i, t in rows}
    near = {2 * k for k in range(150) if N.jaccard(sets[2 * k], sets[2 * k + 1]) >= 0.8}
    assert 100 < len(near)
    left = {r.doc_id for r in P.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    gone = {i for i, _ in rows} - left
    assert gone <= {i + 1 for i in near} and len(gone) >= 0.98 * len(near)


def test_near_groups_of_one_large_bucket(spark):
    """Texts that share most shingles but differ in some: more than LEADERS of them, in several groups."""
    rng = random.Random(7)
    rows = []
    for g in range(3):
        base = words(rng, 300)
        for _ in range(25):
            w = list(base)
            w[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(100, "Short text"), (101, "short  TEXT"), (102, "short texts")]
    got = {r.id: r.component_id for r in N.near_groups(spark.createDataFrame(rows, "id long, text string"), "id").collect()}
    assert len(got) == 78 and len(set(got.values())) == 5
    assert all(len({got[25 * g + k] for k in range(25)}) == 1 for g in range(3)) and got[100] == got[101] != got[102]


def test_line_dedup_short_and_unspaced_lines(spark, tmp_path):
    thai, han = "สวัสดีครับยินดีต้อนรับ", "本办法自公布之日起施行由国务院负责解释"
    rows = [
        (1, f"Share this\n\nnext page\n{han}\n{thai}\n第一章总则"),
        (2, f"share  THIS\n\nshare that\n{han[:8]}后{han[9:]}\n{thai}\n第二章总则\n第一章总则"),
        (3, "  \nnext page\nhttps://a.example/page/1\nhttps://a.example/page/2\nhttps://a.example/page/1"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.dropped_lines) for r in op8_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (6, ""), 2: (7, "0,3,4,6"), 3: (5, "1,4")}
    assert {r.text for r in P.line_dedup(spark, docs, "").where("doc_id = 2").collect()} == {"\nshare that\n第二章总则"}
