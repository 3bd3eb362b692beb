"""Operators on small fixtures: chunks, quality rules, citations, grading, sessions, incremental builds, sources, streams."""
import io
import zipfile

from pyspark.sql import functions as F

from textquarry.functions import text as T
from textquarry.operators import chunker, citation, evaluation, incremental, quality, retrieval, sessions, structure
from textquarry.sources import files, sinks
from textquarry.streaming import events


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_functions(spark):
    assert one(spark, T.han_number(F.lit("一百二十三"))) == 123 and one(spark, T.han_number(F.lit("两万零五"))) == 20005
    assert one(spark, T.han_number(F.lit("十五"))) == 15 and one(spark, T.han_number(F.lit("条"))) is None
    assert one(spark, T.tokens(F.lit("A-1 场外期权 b"), ("场外期权",))) == ["a-1", "b", "场外", "外期", "期权", "term:场外期权"]
    assert one(spark, T.iso_date(F.lit("于2024年3月5日"))) == "2024-03-05"
    assert one(spark, T.literal_overlap(F.lit("abcxy"), F.lit("xyz"))) == 2
    assert one(spark, T.markdown_table(F.array(F.array(F.lit("a"), F.lit("b|c")), F.array(F.lit("d"))))) == "| a | b\\|c |\n| --- | --- |\n| d |  |"
    assert one(spark, T.nfkc(F.lit("ＡＢ①"))) == "AB1"
    assert one(spark, T.nz(F.lit(""), F.lit("b"))) == "b"
    assert one(spark, T.conversation_title(F.lit("a  b " * 20)))[-1] == "…"


def test_pieces_are_trimmed_of_spaces_not_of_their_place(spark):
    assert one(spark, T.sentences(F.lit("a. . \u3000! \u00a0"))) == ["a.", ".", "!"]
    assert one(spark, T.sentences(F.lit("0 a. 1 b1.2 "))) == ["0 a.", "1 b1.", "2"]
    assert one(spark, structure.paragraphs(F.lit("0 a0\n\n 1 b1\n\n \u00a0"))) == ["0 a0", "1 b1"]
    assert one(spark, T.markdown_grid(F.lit("| 0 | 10 |"))) == [["0", "10"]]
    lines = spark.createDataFrame([("p", 1, "| 0 | 10 |")], "path string, line_no int, line string")
    assert files.markdown_rows(lines).first().cells == ["0", "10"]


def test_chunks_cover_blocks(spark):
    text = "第一章 总则\n第一条 " + "内容。" * 500 + "\n第二条 短。\n第二章 附则\n第三条 末。"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "x" * 3000)], "doc_id long, text string")
    rows = chunker.chunk_documents(docs).orderBy("doc_id", "chunk_index").collect()
    assert len({r.chunk_id for r in rows}) == len(rows)
    assert {b for r in rows if r.doc_id == 1 for b in r.block_ids} == set(range(5))
    assert all(r.character_count <= 1200 or r.is_oversized for r in rows) and any(r.is_oversized for r in rows if r.doc_id == 3)
    paths = {r.marker: r.section_path for r in structure.with_hierarchy(structure.blocks_of(docs.where("doc_id = 1"))).collect()}
    assert paths["第二条"] == "第一章 / 第二条" and paths["第三条"] == "第二章 / 第三条"


def chunk(i, body, **more):
    return {"chunk_id": f"c{i}", "document_id": "d", "chunk_index": i, "body_text": body, "text": body, "title": "", "is_oversized": False, "overlap_source_chunk_id": "", "article_start": None, "article_end": None} | more


def test_quality(spark):
    long = "词" * 100
    rows = [chunk(1, long), chunk(2, "第一章 总则"), chunk(3, "目录....12\n项目....13" + long), chunk(4, ""), chunk(5, long), chunk(7, long + "x", overlap_source_chunk_id="zz"), chunk(8, "y" * 1300)]
    schema = "chunk_id string, document_id string, chunk_index long, body_text string, text string, title string, is_oversized boolean, overlap_source_chunk_id string, article_start int, article_end int"
    found = {(r["check"], r.chunk_id) for r in quality.all_issues(spark.createDataFrame(rows, schema)).collect()}
    for want in [("heading_only_chunk", "c2"), ("table_of_contents_residue", "c3"), ("empty_chunk", "c4"), ("duplicate_chunk_body", "c5"), ("chunk_order", "c7"), ("overlap_trace", "c7"), ("character_limit", "c8")]:
        assert want in found
    assert ("very_short_chunk", "c4") not in found and not any(c == "article_order" for c, _ in found)


def test_citations(spark):
    source = "The margin rate is 1.5 per cent. Other words follow here."
    assert citation.align(source, "margin rate") == ("margin rate", "exact")
    assert citation.align(source, "**The  margin** RATE is 1.5") == ("The margin rate is 1.5", "aligned")
    assert citation.align(source, "THE")[1] == "too_short" and citation.align("same same words here, same words here", "SAME WORDS HERE")[1] == "ambiguous"
    assert citation.align(source, "The margin rate is 15 per")[1] == "missing"


def test_grading(spark):
    assert evaluation.quantities("不超过5%，至少 at least 10 days") == [(5.0, "percent", "<="), (10.0, "day", ">=")]
    assert evaluation.judge("应当在5日内报送", "应当在5日内报送", "是否应当报送？")[0] == "correct"
    assert evaluation.judge("不得报送", "应当报送", "是否应当报送？")[0] != "correct"
    assert evaluation.judge("", "x", "y")[0] == "no_answer" and evaluation.polarity("must not do") == "no"


SCRIPT = [("rewrite", True), ("user", True), ("search", True), ("search", True), ("search", True), ("answer", False), ("search", True), ("answer", True), ("next", True), ("answer", True)]
OUTCOMES = ["ok", "ok", "ok", "ok", "refused", "repair", "refused", "ok", "reset", "refused"]


def test_sessions_batch_and_stream(spark, tmp_path):
    rows = [(s, k, e, ok) for s in (1, 2) for k, (e, ok) in enumerate(SCRIPT)]
    df = spark.createDataFrame(rows, "session_id long, seq long, event string, ok boolean")
    batch = sorted(map(tuple, sessions.run_sessions(df).collect()))
    assert [r[4] for r in batch if r[0] == 1] == OUTCOMES
    df.repartitionByRange(2, "seq").sortWithinPartitions("seq").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = sessions.run_sessions_stream(stream).writeStream.format("memory").queryName("fsm").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("fsm").collect())) == batch


def test_event_windows_stream(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    df.write.parquet(f"{tmp_path}/e")
    stream = events.read_events(spark, f"{tmp_path}/e", df.schema)
    q = events.tumbling(stream, "1 day").writeStream.outputMode("complete").format("memory").queryName("tumble").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("tumble").collect())) == sorted((r.start.replace(tzinfo=None), *r[1:]) for r in events.tumbling(df, "1 day").collect())


def test_incremental(spark):
    s = "document_id string, hash string, version string"
    state = spark.createDataFrame([("a", "1", "v"), ("b", "2", "v"), ("c", "3", "v")], s)
    now = spark.createDataFrame([("a", "1", "v"), ("b", "9", "v"), ("d", "4", "v")], s)
    assert {r.document_id: r.status for r in incremental.plan(now, state).collect()} == {"a": "reused", "b": "changed", "c": "stale", "d": "new"}
    assert sorted(map(tuple, incremental.rebuild(now, state, lambda x: x).collect())) == sorted(map(tuple, now.collect()))


def test_fusion_is_symmetric_and_capped(spark):
    a = spark.createDataFrame([(1, d, 1.0 / r, r) for r, d in enumerate((5, 6, 7, 8), 1)], "query_id long, doc_id long, bm25 double, rank long")
    b = spark.createDataFrame([(1, d, 1.0 / r, r) for r, d in enumerate((8, 7, 6, 5), 1)], "query_id long, doc_id long, vector double, rank long")
    fused = retrieval.reciprocal_rank_fusion(a, b)
    rrf = {r.doc_id: r.rrf for r in fused.collect()}
    assert rrf[5] == rrf[8] and rrf[6] == rrf[7]
    assert retrieval.diversify(fused.withColumn("document", F.lit("one")), "document").count() == 3
    lists = spark.createDataFrame([(1, 0, 1, 10), (1, 0, 2, 11), (1, 1, 1, 10), (1, 1, 2, 12)], "query_id long, list_no int, rank long, doc_id long")
    assert [r.doc_id for r in retrieval.interleave(lists).orderBy("rank").collect()] == [10, 12, 11]


def test_files_and_sinks(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    xml = f"<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val='Heading1'/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('c')}</w:tr></w:tbl></w:body></w:document>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.docx").write_bytes(data.getvalue())
    (tmp_path / "d" / "bad.docx").write_bytes(b"PK broken")
    (tmp_path / "d" / "~$lock.docx").write_bytes(b"x")
    (tmp_path / "d" / "t.md").write_text("# A\none\n\ntwo\n## B\nthree")
    seen = {r["name"]: r.reason for r in files.inventory(spark, f"{tmp_path}/d").collect()}
    assert seen["x.docx"] == "" and seen["~$lock.docx"] == "lock file"
    blocks = files.scan_with(files.binary_files(spark, f"{tmp_path}/d", "docx").where("path not like '%lock%'"), files.parse_docx).orderBy("path", "block_seq").collect()
    assert [(b.source_kind, b.text) for b in blocks if b.path.endswith("x.docx")] == [("paragraph", "Title"), ("table", "| a | b |\n| --- | --- |\n| c |  |")]
    assert any(b.source_kind == "failed" and b.warnings for b in blocks)
    assert files.text_blocks(files.binary_files(spark, f"{tmp_path}/d", "md")).count() == 3
    assert files.html_texts("<p>a<script>b</script> &amp; c") == ["a", "b", "& c"]
    m = spark.createDataFrame([({"api_key": "k", "note": "n"},)], "m map<string,string>").select(sinks.redacted(F.col("m")).alias("m")).first().m
    assert m == {"api_key": "[redacted]", "note": "n"}
    page = sinks.viewer_html("<script>__DATA__</script>", spark.createDataFrame([("</script>",)], "t string"))
    assert page.count("</script>") == 1
    fact = sinks.manifest(spark.range(5), "id", version="v1").first()
    assert (fact["rows"], fact.documents, fact.version) == (5, 5, "v1")


def test_entry_without_llm(tmp_path):
    """The entry module imports, and its queries are there, where the training-data operators have been taken out."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "textquarry", tmp_path / "textquarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and not any(k.startswith('op1_') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_front_matter(spark):
    from textquarry.operators import front_matter as M

    lines = ["某监督管理委员会令", "〔2020〕第12号", "现予公布《试行管理办法》，自公布之日起施行。", "2020年5月1日", "试行管理办法", "（2020年5月1日发布）", "第一条 内容。", "第二条 试行管理办法", "来源", "https://x.example/a"]
    blocks = spark.createDataFrame([(1, k, t, "试行管理办法") for k, t in enumerate(lines)], "doc_id long, block_seq int, text string, document_title string")
    kept, removed = M.clean(blocks)
    rules = {r.block_seq: r.rule_id for r in removed.collect()}
    assert rules == {0: "split_front_document_number", 1: "split_front_document_number", 2: "publication_wrapper", 3: "publication_signature_date", 5: "front_promulgation_parenthetical", 9: "trailing_source_reference"}
    assert M.clean(kept)[1].count() == 0
    toc = ["第一章 总则", "第二章 附则", "第一章 总则", "第一条 甲", "第二章 附则", "第二条 乙"]
    left = M.without_repeated_contents(spark.createDataFrame([(1, k, t) for k, t in enumerate(toc)], "doc_id long, block_seq int, text string"))
    assert sorted(r.block_seq for r in left.collect()) == [2, 3, 4, 5]
    assert one(spark, M.readable_symbols(F.lit(chr(0xF0E5) + "a" + chr(0xE004) + chr(0xF8FE)))) == "∑a[未映射公式符号U+F8FE]"


def test_fuzzy_titles(spark):
    """Against all pairs, scored and assigned one after the other."""
    import difflib
    import random

    from textquarry.operators import catalog

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 7)))
    base = [" ".join(word() for _ in range(rng.randint(1, 5))) for _ in range(40)]

    def typo(t):
        c = list(t)
        for _ in range(rng.randint(0, 1 + len(c) // 5)):
            c[rng.randrange(len(c))] = rng.choice("abcdexyz")
        return "".join(c)

    left = [(k, typo(rng.choice(base))) for k in range(60)] + [(60, "the quick brown fox jumps over the lazy dog zqxjkv"), (61, None), (62, "")]
    right = [(k, typo(rng.choice(base))) for k in range(70)] + [(70, "the quick brown fox jumps over the lazy dog"), (71, "zqxjkv"), (72, None)]
    ratio = lambda a, b: round(difflib.SequenceMatcher(None, a, b, autojunk=False).ratio(), 6)
    pairs = {(i, j): ratio(a, b) for i, a in left for j, b in right if a and b}
    dfs = [spark.createDataFrame(x, "id long, title string") for x in (left, right)]
    for least in (0.69, 0.8):
        assert {(r.left_id, r.right_id): r.similarity for r in catalog.similar_titles(*dfs, least).collect()} == {k: v for k, v in pairs.items() if v >= least}
    used, want = set(), []
    for i, a in left:
        free = sorted((-v, j) for (x, j), v in pairs.items() if x == i and j not in used)
        if free and -free[0][0] >= 0.72 and (len(free) == 1 or round(free[1][0] - free[0][0], 6) >= 0.03):
            used.add(free[0][1])
            want.append((i, free[0][1], -free[0][0]))
    assert sorted(map(tuple, catalog.fuzzy_titles(*dfs).collect())) == want and (60, 70) in {w[:2] for w in want}


def test_grading_forms():
    assert evaluation.canonical("必须　ＡＢ c，不可以") == "应当abc,不得"
    assert evaluation.question_type("是否应当？以及何时？", "x") == "compound" and evaluation.question_type("是否应当？", "x") == "binary"
    good = {"conclusion": "c", "reasoning": "r", "basis": [{"evidence_id": "e", "quote": "q"}]}
    assert evaluation.structure_issues(good) == []
    assert evaluation.structure_issues({"conclusion": " ", "basis": [{}, 1]}) == ["reasoning is missing", "conclusion is empty", "basis 0 has no id or quote", "basis 1 has no id or quote"]
    assert evaluation.structure_issues([]) == ["answer is no object"]


def test_bundle_gates(spark):
    import pytest

    from textquarry.operators import corpus as O

    docs = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<double>")
    manifest = O.input_fingerprint(docs, "id", F.col("text")).first().asDict()
    O.check_bundle(docs, vectors, manifest, "id", F.col("text"), 2)
    other = docs.withColumn("text", F.upper("text"))
    for args in ((other, vectors, 2), (docs, vectors.where("id = 1"), 2), (docs, vectors.unionByName(vectors), 2), (docs, vectors, 3)):
        with pytest.raises(ValueError):
            O.check_bundle(args[0], args[1], manifest, "id", F.col("text"), args[2])
    for bad in (lambda: O.referenced(docs, docs.where("id = 1"), "id"), lambda: O.union_unique([docs, docs], "id"), lambda: O.selected(docs, "id", spark.createDataFrame([(9,)], "id long"))):
        with pytest.raises(ValueError):
            bad()
