"""The chunker's steps on small documents."""
import random

from textquarry.functions.numbers import han_value
from textquarry.operators import chunker as C
from textquarry.operators import structure


def blocks(spark, lines):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(list(enumerate(lines)), "k int, text string").withColumn("c", structure.classify(F.col("text")))
    return [(r.k, r.text, r.c.kind, r.c.marker) for r in df.orderBy("k").collect()]


def made(spark, lines, **more):
    keys = ("index", "path", "body", "ids", "oversized", "reason", "source", "overlap", "parent", "prefix")
    return [dict(zip(keys, r, strict=True)) for r in C.chunk_blocks(blocks(spark, lines), **more)]


def test_numbers():
    for text, want in [("一百二十三", 123), ("十五", 15), ("两万零五", 20005), ("三点一四", 3.14), ("一点五万", 15000), ("二亿三千万", 230_000_000), ("12", 12), ("1.5万", 15000), ("二〇二四", 2024), ("条", None), ("", None), ("点五", 0.5)]:
        assert han_value(text) == want or abs(han_value(text) - want) < 1e-9, text


def test_tree_levels_and_references(spark):
    root = C.build_tree(blocks(spark, ["第一章 总则", "第一条 甲方应当。", "正文一。", "第三条 乙方应当。", "第二条 的规定适用。", "第二章 附则", "第四条 施行。"]))
    one, two = root.children
    assert [c.marker for c in one.children] == ["第一条", "第三条"] and [c.marker for c in two.children] == ["第四条"]
    assert one.children[1].children[0].kind == "text"  # a smaller number is a reference
    assert C.hierarchy(two.children[0]) == {"chapter": "第二章", "article": "第四条"}
    assert C.render(one).split("\n")[0] == "第一章 总则" and C.seqs_of(one) == [0, 1, 2, 3, 4]


def test_headings_restart_the_count(spark):
    root = C.build_tree(blocks(spark, ["甲类业务规则", "第一条 一。", "第二条 二。", "乙类业务规则", "第一条 三。", "第二条 四。"]))
    assert [c.text for c in root.children] == ["甲类业务规则", "乙类业务规则"] and [len(c.children) for c in root.children] == [2, 2]


def test_declaration_before_the_first_article(spark):
    root = C.build_tree(blocks(spark, ["声明", "以下内容真实。", "第一条 内容。"]))
    assert [c.kind for c in root.children] == ["heading", "article"]


def test_short_document_is_one_chunk_and_long_article_is_split(spark):
    got = made(spark, ["第一章 总则", "第一条 短。", "第二条 也短。"])
    assert len(got) == 1 and got[0]["ids"] == [0, 1, 2] and got[0]["path"] == "第一章"
    got = made(spark, ["第一条 " + "这是一个完整的句子。" * 300])
    assert len(got) > 2 and all(C.size(g["body"]) <= 1200 and g["body"].endswith("。") for g in got)
    assert made(spark, ["无" * 3000])[0]["oversized"]


def test_all_blocks_are_covered(spark):
    lines = [f"第{k}条 " + "内容很多的句子。" * (k * 7 % 90) for k in range(1, 30)] + ["| a | b |", "尾部"]
    assert {s for g in made(spark, lines) for s in g["ids"]} == set(range(len(lines)))


def test_table_pieces_repeat_the_header():
    table = "| 名 | 值 |\n| --- | --- |\n" + "\n".join(f"| 行{k} | {'x' * 50} |" for k in range(60))
    pieces = C.split_table(table, 1200)
    assert len(pieces) > 2 and all(p.startswith("| 名 | 值 |\n| --- | --- |\n") and C.size(p) <= 1200 for p in pieces)
    assert sum(p.count("行") for p in pieces) == 60


def test_parts_do_not_mix(spark):
    got = made(spark, ["第一部分 甲", "第一条 短。", "第二部分 乙", "第一条 短。"])
    assert [g["path"].split(" / ")[0] for g in got] == ["第一部分", "第二部分"]
    assert C.compatible({"chapter": "一"}, {}) and not C.compatible({"part": "一"}, {}) and not C.compatible({"chapter": "一"}, {"chapter": "二"})


def test_topic_change_only_beyond_the_target():
    unit = lambda t: C.Unit({}, t, "text", [0])
    topics = {"cats": ("cat",), "dogs": ("dog",)}
    assert len(C.pack([unit("cat " * 10), unit("dog " * 10)], topics=topics)) == 1
    assert len(C.pack([unit("cat " * 220), unit("dog " * 100)], topics=topics)) == 2
    assert len(C.pack([unit("cat " * 220), unit("dog " * 100)])) == 1
    assert len(C.pack([unit("a" * 300), unit("b" * 300)], forced=frozenset({1}))) == 2


def test_introduction_goes_with_its_list():
    unit = lambda t, kind="text": C.Unit({}, t, kind, [0])
    got = C.pack([unit("a" * 1000), unit("包括下列各项："), unit("（一）" + "b" * 400, "item")])
    assert [len(c) for c in got] == [1, 2]


def test_overlap_reasons_and_budget():
    unit = lambda t, kind="text": C.Unit({}, t, kind, [0])
    body = unit("（二）第二项内容。" + "c" * 100, "item")
    reason, text, parent = C.overlaps([[unit("应当报送下列材料："), unit("（一）第一项。", "item")], [body]])[1]
    assert reason in ("enumeration", "numbering") and text == "应当报送下列材料：\n（一）第一项。" and parent == ""
    long = unit("应当报送下列材料：\n（一）" + "x" * 900, "item")
    reason, text, parent = C.overlaps([[long], [body]])[1]
    assert reason and text == "" and parent == "应当报送下列材料："
    assert C.overlaps([[unit("一句。")], [unit("上述规定适用。")]])[1][0] == "dependency"
    assert C.overlaps([[unit("没有结束的")], [unit("句子在这里。")]])[1][0] == "sentence"
    assert C.overlaps([[unit("一句：")], [C.Unit({}, "新的标题", "heading", [1])]])[1] == ("", "", "")
    assert C.overlaps([[unit("一句。")], [unit("另一句。")]])[1][0] == ""


def test_context_prefix():
    assert C.context_prefix("试行办法", {"chapter": "第一章", "article": "第二条"}, "第二条 内容") == "试行办法 / 第一章"


def test_headings_merge_forward_and_short_tails_back():
    unit = lambda t, kind="text": C.Unit({}, t, kind, [0])
    got = C.pack([unit("a" * 1199), unit("第二章 总则", "chapter"), unit("b" * 1000), unit("c" * 190)])
    assert [u.text[:2] for u in got[1]] == ["第二", "bb", "cc"]
    assert len(C.pack([unit("a" * 1100), unit("d" * 150), unit("e" * 1100)])) == 3


def test_lines_are_classified_alike_in_python(spark):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    parts = ["第一章", "第 二 条", "第三节", "第四款", "第五部分", "（一）", "( 2)", "3.", "4．5.6", "五、", "附件 七", "附录", "|", "....", "……", "·" * 7, "标题", "a", " ", "\t", "\r", " ", " ", "。", ";", "１", "x" * 40]
    lines = ["".join(rng.choices(parts, k=rng.randrange(6))) for _ in range(4000)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, x string").select("k", structure.classify(F.col("x")).alias("c"))
    for r in df.collect():
        assert structure.classified(lines[r.k]) == (r.c.kind, r.c.marker), repr(lines[r.k])


def test_a_document_is_chunked_where_it_is_read(spark):
    from pyspark.sql import functions as F

    from textquarry.functions import text as T

    docs = spark.createDataFrame([(1, "s", "a\x1cb c　d\n第一条 短。"), (2, "s", None), (3, "s", " \n"), (4, None, "句子在这里。" * 500)], "doc_id long, source string, text string")
    got = C.chunk_documents(docs, title_col="source")
    plan = got._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "FlatMapGroups" not in plan
    rows = got.withColumn("n", T.body_chars("body_text")).where(F.col("doc_id") == 1).collect()
    assert [r.character_count for r in rows] == [len("a\x1cbcd第一条短。")] and rows[0].context_prefix == "s"
    assert {r.doc_id for r in got.collect()} == {1, 4}
