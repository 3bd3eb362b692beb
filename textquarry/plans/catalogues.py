"""Queries over metadata, catalogue joins, chunk spans and reviews."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textquarry.functions import metadata as M
from textquarry.functions import text as T
from textquarry.operators import catalog, chunker, evaluation, front_matter, structure
from textquarry.sources import sinks

from .base import Catalogue, Tables

C = Catalogue()


@C.add()
def f15_metadata(t: Tables):
    """Inferred metadata of every document; no catalogue, so the name is the source's."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return t.documents.select("doc_id", M.infer(lines, F.col("text"), F.concat("source", F.lit(".txt"))).alias("m")).select("doc_id", "m.*")


@C.add("SELECT doc_id, 'doc_' || substring(sha256(concat_ws(chr(31), regexp_replace(source, '[_-]', '', 'g'), doc_id::VARCHAR, lang, '')), 1, 24) AS id FROM documents")
def f38_document_id(t: Tables):
    return t.documents.select("doc_id", M.document_id("source", F.col("doc_id").cast("string"), "lang", F.lit("")).alias("id"))


@C.add("""SELECT doc_id, sha256('{"lang":"' || lang || '","source":"' || source || '"}') AS h FROM documents""")
def f37_metadata_hash(t: Tables):
    return t.documents.select("doc_id", M.metadata_hash("source", "lang").alias("h"))


@C.add("SELECT s_suppkey, trim(regexp_extract(s_name || ', b', '^([^,]*)', 1)) AS authority FROM supplier")
def f32_first_authority(t: Tables):
    return t.supplier.select("s_suppkey", M.navigation_authority(F.concat("s_name", F.lit(", b"))).alias("authority"))


@C.add("SELECT page_id, CASE WHEN regexp_matches(lower(url), '^[^?#]*\\.pdf([?#]|$)') THEN 'pdf' ELSE 'detail' END AS kind FROM pages")
def f46_link_type(t: Tables):
    return t.pages.select("page_id", M.link_type("url").alias("kind"))


@C.add("SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'good' ELSE d.lang END AS tag FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def p6_merge_metadata(t: Tables):
    known = t.labels.select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("").alias("catalogue_tag"))
    return t.documents.join(known, "doc_id", "left").select("doc_id", M.merged("lang", "catalogue_tag").alias("tag"))


@C.add("SELECT doc_id, printf('[%s] %s (%.6f)', doc_id::VARCHAR, source, n_chars / 1000.0::DOUBLE) || chr(10) || lang AS line FROM documents")
def p13_context_lines(t: Tables):
    return t.documents.select("doc_id", M.context_line("doc_id", "source", F.col("n_chars") / 1000.0, "lang").alias("line"))


@C.add("""SELECT doc_id, replace(replace(replace(lang || '<&>', '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e') AS escaped FROM documents""")
def p15_escape(t: Tables):
    return t.documents.select("doc_id", T.escape_markup(F.concat("lang", F.lit("<&>"))).alias("escaped"))


@C.add("""SELECT doc_id, '"' || replace(source || '"x', '"', '""') || '"' AS cell FROM documents""")
def k5_csv_cell(t: Tables):
    return t.documents.select("doc_id", sinks.csv_cell(F.concat("source", F.lit('"x'))).alias("cell"))


@C.add()
def k6_manifest(t: Tables):
    return sinks.manifest(t.documents, "doc_id", version="v1")


@C.add("""WITH b AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::BIGINT AS seq, unnest(string_split(text, chr(10))) AS line FROM documents),
 o AS (SELECT doc_id, seq, line, coalesce(sum(length(line) + CASE WHEN trim(line) = '' THEN 0 ELSE 2 END) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM b)
 SELECT doc_id * 1000 + seq // 3 AS chunk_id, min(s)::BIGINT AS start_char, max(s + length(line))::BIGINT AS end_char FROM o GROUP BY doc_id * 1000 + seq // 3""")
def j5_block_spans(t: Tables):
    """Every three lines are a chunk."""
    blocks = structure.offsets(structure.blocks_of(t.documents))
    key = F.col("doc_id") * 1000 + F.floor(F.col("block_seq") / 3)
    chunks = blocks.groupBy("doc_id", key.alias("chunk_id")).agg(F.collect_list("block_seq").alias("block_ids"))
    return catalog.block_spans(chunks, blocks)


@C.add("""WITH c AS (SELECT conv_id * 100 + turn AS chunk_id, conv_id, CASE WHEN turn % 2 = 1 THEN conv_id * 100 + turn - 1 END AS source FROM conversations)
 SELECT a.chunk_id, b.chunk_id AS source_id, a.source IS NOT NULL AND b.chunk_id IS NULL AS broken FROM c a LEFT JOIN c b ON a.source = b.chunk_id""")
def j6_overlap_trace(t: Tables):
    c = t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("chunk_id"), F.when(F.col("turn") % 2 == 1, F.col("conv_id") * 100 + F.col("turn") - 1).alias("source"))
    source = c.select(F.col("chunk_id").alias("source_id"))
    return c.join(source, F.col("source") == F.col("source_id"), "left").select("chunk_id", "source_id", (F.col("source").isNotNull() & F.col("source_id").isNull()).alias("broken"))


def host_titles(t: Tables):
    """Host names of all pages, and those without their first label."""
    hosts = t.pages.select(F.regexp_extract("url", "^https?://([^/:?#]+)", 1).alias("id")).where("id <> ''").distinct()
    return hosts.withColumn("title", F.col("id")), hosts.select(F.regexp_replace("id", r"^[^.]+[.](?=.*[.].*[.])", "").alias("id")).distinct().withColumn("title", F.col("id"))


@C.add()
def j9_fuzzy_match(t: Tables):
    """Host names of pages against shortened ones, each of these taken once."""
    return catalog.fuzzy_titles(*host_titles(t))


@C.add("SELECT c_custkey, CASE n WHEN 1 THEN 'matched' ELSE CASE WHEN n > 1 THEN 'conflict' ELSE 'none' END END AS match_status, CASE WHEN n = 1 THEN k END AS match_id FROM customer LEFT JOIN (SELECT s_nationkey, count(*) AS n, min(s_suppkey) AS k FROM supplier GROUP BY s_nationkey) ON c_nationkey = s_nationkey")
def j2_unique_match(t: Tables):
    return catalog.unique_match(t.customer, t.supplier, F.col("c_nationkey"), F.col("s_nationkey"), "s_suppkey").select("c_custkey", "match_status", "match_id")


@C.add("SELECT 'missing' AS gate, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j19_answer_gates(t: Tables):
    return catalog.gates(t.documents.select("doc_id"), t.labels.select("doc_id"), "doc_id")


@C.add("SELECT conv_id, turn, n = p + 1 AS continues FROM (SELECT conv_id, turn, length(text) % 7 AS n, lag(length(text) % 7) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) WHERE p IS NOT NULL")
def w14_list_continuity(t: Tables):
    """List numbers (here by length) that go on from the turn before."""
    n = F.length("text") % 7
    before = F.lag(n).over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.select("conv_id", "turn", n.alias("n"), before.alias("p")).where("p is not null").select("conv_id", "turn", (F.col("n") == F.col("p") + 1).alias("continues"))


@C.add("SELECT source, count(*) AS documents, count(CASE WHEN quality = 1 AND toxic = 0 THEN 1 END) AS pass, count(CASE WHEN quality = 0 THEN 1 END) AS fix, count(CASE WHEN toxic = 1 THEN 1 END) AS manual FROM labels JOIN documents USING (doc_id) GROUP BY source")
def a18_review_counts(t: Tables):
    n = lambda p: F.count(F.when(F.expr(p), 1))
    met = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    return met.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), n("quality = 1 and toxic = 0").alias("pass"), n("quality = 0").alias("fix"), n("toxic = 1").alias("manual"))


@C.add("SELECT lang, count(DISTINCT source) AS authorities, count(*) AS documents, sum(n_chars)::BIGINT AS characters FROM documents GROUP BY lang")
def a17_viewer_summary(t: Tables):
    return t.documents.groupBy("lang").agg(F.countDistinct("source").alias("authorities"), F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("characters"))


@C.add("SELECT conv_id, string_agg(role, '>' ORDER BY first_turn) AS roles FROM (SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY conv_id, role) GROUP BY conv_id")
def a21_grouped_sources(t: Tables):
    """Distinct entries of a group in the order of their first use."""
    firsts = t.conversations.groupBy("conv_id", "role").agg(F.min("turn").alias("turn"))
    return firsts.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">").alias("roles"))


@C.add()
def a15_verdict_report(t: Tables):
    """Grades of answers by section (language of the first document of that id) and verdict, with totals."""
    a = t.conversations.where("role = 'assistant'").select((F.col("conv_id") * 100 + F.col("turn")).alias("question_id"), F.lit("what").alias("question"), T.latin_lead("text").alias("truth"), F.col("text").alias("answer"))
    sections = t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("question_id"), F.concat(F.lit("s"), (F.col("conv_id") % 3).cast("string")).alias("section"))
    return evaluation.verdict_report(evaluation.judge_answers(a), sections)


@C.add("SELECT doc_id, blocks, blocks AS covered FROM (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS blocks FROM documents) WHERE blocks > 0")
def a9_block_coverage(t: Tables):
    """Every block that isn't blank is in some chunk."""
    chunks = chunker.chunk_documents(t.documents)
    blocks = structure.blocks_of(t.documents).where(F.trim("text") != "")
    return catalog.coverage(blocks, chunks)


@C.add()
def d16_front_matter(t: Tables):
    """What the front-matter rules remove; a document's first line stands for its title."""
    blocks = t.documents.select("doc_id", T.latin_lead("text").alias("document_title"), F.posexplode(F.split("text", r"\n")).alias("block_seq", "text"))
    return front_matter.judge(blocks).where("rule_id <> ''").select("doc_id", F.col("block_seq").cast("long").alias("block_seq"), "rule_id")


@C.add()
def d17_repeated_contents(t: Tables):
    return front_matter.without_repeated_contents(structure.blocks_of(t.documents)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"))


@C.add("SELECT doc_id, md5(translate(text, 'abcdefgh', 'αβχδεφγη')) AS h FROM documents")
def f3_symbols(t: Tables):
    """Texts whose a to h are set in the Symbol font: the private-use characters read as Greek letters."""
    symbols = F.translate("text", "abcdefgh", "".join(chr(0xF000 + ord(c)) for c in "abcdefgh"))
    return t.documents.select("doc_id", F.md5(front_matter.readable_symbols(symbols).cast("binary")).alias("h"))


@C.add("SELECT doc_id, md5(text) AS hash, 'v1' AS version FROM documents")
def x10_rebuild(t: Tables):
    """A rebuild from the labelled documents' state, outdated where the label says bad, equals a full build."""
    from textquarry.operators import incremental

    rows = t.documents.select("doc_id", F.md5(F.col("text").cast("binary")).alias("hash"), F.lit("v1").alias("version"))
    state = rows.join(t.labels, "doc_id").select("doc_id", F.when(F.col("quality") == 0, "").otherwise(F.col("hash")).alias("hash"), "version")
    return incremental.rebuild(rows, state, lambda x: x, "doc_id")
