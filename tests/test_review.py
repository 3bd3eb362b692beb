"""Review checks and layout functions on small tables."""
from textquarry.operators import layout as L
from textquarry.operators import review as R

LONG = "这是一个足够长的正文，用来核对它是否能在来源里按顺序找到。" * 2


def found(df):
    return sorted((r["check"], r.chunk_id) for r in df.collect())


def test_review(spark):
    rows = [("d", "a", 1, "下列材料：\n（一）甲；", 0, 9, "h", "", None, None, [0]), ("d", "b", 2, "（二）乙。", None, 9, "", "a", None, 3, [1, 9]), ("d", "c", 3, LONG + "\x07" + "=" * 12, 9, 20, "h", "a", 5, 7, [2]), ("x", "e", 1, LONG, 5, 3, "h", "", None, None, [0]), ("d", "f", 4, LONG + "\x07" + "=" * 12, 9, 20, "h", "", None, None, [2])]
    chunks = spark.createDataFrame(rows, "document_id string, chunk_id string, chunk_index int, body_text string, start_char int, end_char int, content_hash string, overlap_source_chunk_id string, overlap_start int, overlap_end int, block_ids array<int>")
    assert found(R.positions(chunks)) == [("clean_text_position", "b"), ("clean_text_position", "e"), ("incremental_hashes", "b"), ("overlap_coordinates", "b")]
    assert found(R.noise(chunks.where("chunk_id in ('a', 'c')"))) == [("noise_control_character", "c"), ("noise_repeated_sign", "c")]
    assert found(R.split_enumerations(chunks)) == [("possible_split_enumeration", "a")]
    documents = spark.createDataFrame([("d",)], "document_id string")
    blocks = spark.createDataFrame([("d", 0), ("d", 1), ("d", 2)], "document_id string, block_seq int")
    assert found(R.unknown_sources(chunks, documents, blocks)) == [("missing_source_block", "b"), ("missing_structured_document", "e")]
    sources = spark.createDataFrame([("c", "完全不同的来源文字" * 9), ("e", "前文 " + LONG + " 后文"), ("f", LONG + "\x07" + "=" * 11 + "-" + "=")], "chunk_id string, source string")
    assert found(R.untraceable(chunks, sources)) == [("body_not_traceable", "c")]
    assert found(R.repeated_bodies(chunks)) == [("duplicate_in_document", "f")]
    meta = chunks.selectExpr("document_id", "chunk_id", "'t' as title", "concat('p', chunk_id) as file_path")
    catalogue = spark.createDataFrame([("d", "t", "pa"), ("x", "u", "pe")], "document_id string, title string, file_path string")
    assert found(R.wrong_metadata(meta, catalogue, ("title",))) == [("file_path_mismatch", "b"), ("file_path_mismatch", "c"), ("file_path_mismatch", "f"), ("metadata_mismatch", "e")]
    issues = R.all_checks(R.split_enumerations(chunks), spark.createDataFrame([("very_short_chunk", "minor", "d", "b"), ("very_short_chunk", "minor", "x", "e")], "check string, severity string, document_id string, chunk_id string"))
    assert {(r["check"], r.chunk_id): r.resolution for r in R.resolved(issues, chunks).collect()} == {("possible_split_enumeration", "a"): "goes on in the next chunk", ("very_short_chunk", "b"): "part of a list", ("very_short_chunk", "e"): ""}


def test_lines_and_tables():
    assert L.joined_lines(["第一条 本办法适用于", "境内机构。", "第二条 另有规定的，", "从其规定。", "", "The regu-", "lation is", "here."]) == ["第一条 本办法适用于境内机构。", "第二条 另有规定的，从其规定。", "The regulation is here."]
    assert L.is_guide_heading("业务流程说明") and not L.is_guide_heading("机构应当报告") and not L.is_guide_heading("一句话。") and not L.is_guide_heading("（一）项")
    assert L.joined_lines(["业务流程说明", "申请人提交材料。"]) == ["业务流程说明", "申请人提交材料。"]
    assert L.running_heads([["head", "a", "b", "c", "1"], ["head", "d", "e", "f", "2"]]) == {"head"}
    assert L.running_heads([["x", str(k), "y", "z", "w"] if k < 2 else [str(k), "p", "q", "r", "s"] for k in range(6)]) == {"p", "r", "s"}
    assert L.normal_table([["a ", None, " b"], ["", "", ""], ["c", "", "d\ne"]]) == [["a", "b"], ["c", "d e"]] and L.normal_table([["only one"], ["column"]]) is None
    assert L.table_sentences([["名称", "金额", ""], ["", "万元", ""], ["甲", "12", "x"]]) == ["名称：甲；金额 / 万元：12；第3列：x"]


def test_pages(spark):
    rows = [(1, 0, 1, 3, 0.5, 0.9), (1, 1, 2, 3, 0.1, 0.95), (1, 2, 3, 3, 0.2, 0.4), (1, 3, 4, 3, 0.1, 0.9), (1, 4, 5, 4, 0.1, 0.5)]
    blocks = spark.createDataFrame(rows, "doc_id int, block_seq int, page int, width int, top double, bottom double")
    assert {r.block_seq: r.part_of for r in L.stitched(blocks).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}
    texts = spark.createDataFrame([(1, 0, "2024-03-05 10:11"), (1, 1, "正文"), (1, 2, "计算公式为："), (1, 3, "无"), (1, 4, "计算公式："), (1, 5, "a = b"), (1, 20, "2024-03-05")], "doc_id int, block_seq int, text string")
    assert sorted(r.block_seq for r in L.without_front_dates(texts).collect()) == [1, 2, 3, 4, 5, 20]
    assert [r.block_seq for r in L.missing_formula(texts).collect()] == [2]
