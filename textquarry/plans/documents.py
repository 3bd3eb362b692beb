"""Queries over text functions, structure, quality, citations, labels, grading and sessions."""
from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.functions import text as T
from textquarry.operators import chunker, citation, classification, evaluation, quality, sessions, structure
from textquarry.sources import files

from .base import Catalogue, Tables

C = Catalogue()
LINES = "b AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::BIGINT AS block_seq, unnest(string_split(text, chr(10))) AS text FROM documents)"
TOKEN = "[a-z0-9]+(?:[._/-][a-z0-9]+)*"


def _long(c):
    return F.col(c).cast("long").alias(c)


# Functions
@C.add(r"SELECT doc_id, length(regexp_replace(text, '\s+', '', 'g')) AS chars FROM documents")
def f2_compact_len(t: Tables):
    return t.documents.select("doc_id", T.body_chars("text").cast("long").alias("chars"))


@C.add("SELECT doc_id, substring(sha256(concat_ws(chr(31), doc_id::VARCHAR, source, lang)), 1, 16) AS id FROM documents")
def f4_stable_id(t: Tables):
    return t.documents.select("doc_id", T.stable_id("doc_id", "source", "lang").alias("id"))


@C.add(rf"WITH {LINES} SELECT doc_id, block_seq FROM b WHERE regexp_matches(trim(text), '(?i)^(?:-?\s*\d+\s*-?|\d+\s*/\s*\d+|[ivxlcdm]{{1,8}})$')")
def f5_page_number(t: Tables):
    return structure.blocks_of(t.documents).where(T.is_page_number("text")).select("doc_id", _long("block_seq"))


@C.add("SELECT n_regionkey::BIGINT AS region, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS md FROM nation GROUP BY n_regionkey")
def f7_md_table(t: Tables):
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda r: F.array(r["n_nationkey"].cast("string"), r["n_name"]))
    return t.nation.groupBy(F.col("n_regionkey").cast("long").alias("region")).agg(T.markdown_table(F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), rows)).alias("md"))


@C.add(f"SELECT doc_id, len(regexp_extract_all(lower(text), '{TOKEN}')) AS n, sha256(array_to_string(regexp_extract_all(lower(text), '{TOKEN}'), ' ')) AS h FROM documents")
def f18_tokens(t: Tables):
    return t.documents.select("doc_id", T.tokens("text").alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.sha2(F.array_join("t", " "), 256).alias("h"))


@C.add(r"""SELECT doc_id, md5(lower(regexp_replace(regexp_extract(text, '^([^\n]*)', 1), '[\s,.;:!?''"<>\[\]]', '', 'g'))) AS k FROM documents""")
def f16_title_keys(t: Tables):
    return t.documents.select("doc_id", F.md5(T.title_key(F.regexp_extract("text", r"^([^\n]*)", 1)).cast("binary")).alias("k"))


@C.add(r"WITH l AS (SELECT doc_id, trim(regexp_replace(regexp_extract(text, '^([^\n]*)', 1), '\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 28 THEN left(t, 28) || '…' ELSE t END AS lead FROM l")
def f42_conversation_title(t: Tables):
    return t.documents.select("doc_id", T.conversation_title(F.regexp_extract("text", r"^([^\n]*)", 1)).alias("lead"))


@C.add("""WITH p AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations),
 n AS (SELECT conv_id, turn, text, nxt, unnest(range(1, least(480, length(text), length(nxt)) + 1)) AS n FROM p WHERE nxt IS NOT NULL)
 SELECT conv_id, turn, coalesce(max(CASE WHEN right(text, n) = left(nxt, n) THEN n END), 0)::BIGINT AS overlap FROM n GROUP BY ALL""")
def f26_overlap(t: Tables):
    from pyspark.sql import Window

    p = t.conversations.withColumn("nxt", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("nxt is not null")
    return p.select("conv_id", "turn", T.literal_overlap("text", "nxt").cast("long").alias("overlap"))


@C.add(r"""WITH k AS (SELECT item_id, regexp_replace(text, '\s+', '', 'g') AS a FROM benchmark), d AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS b FROM documents)
 SELECT item_id, doc_id, round(length(a) / length(b)::DOUBLE, 6) AS similarity FROM k JOIN d ON contains(b, a)""")
def f27_containment(t: Tables):
    """Benchmark items that documents hold; items meet documents on their rarest token, not all pairs."""
    docs = t.documents
    first = t.benchmark.select("item_id", F.col("text").alias("item"), F.explode(F.array_distinct(T.tokens("text"))).alias("term"))
    rarity = docs.select("doc_id", F.explode(F.array_distinct(T.tokens("text"))).alias("term")).join(first.select("term").distinct(), "term", "left_semi")
    df = rarity.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    key = first.join(df, "term", "left").groupBy("item_id", "item").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"))
    met = key.join(rarity, "term").join(docs.select("doc_id", "text"), "doc_id")
    return met.select("item_id", "doc_id", F.round(T.containment("item", "text"), 6).alias("similarity")).where("similarity > 0")


@C.add("""WITH x AS (SELECT b.item_id, b.text AS e, d.text AS a FROM benchmark b JOIN documents d ON d.doc_id = b.item_id), g AS (SELECT item_id, a, substring(e, i::BIGINT, 2) AS p FROM (SELECT *, unnest(range(1, length(e))) AS i FROM x))
 SELECT item_id, round(count(CASE WHEN contains(a, p) THEN 1 END) / count(*)::DOUBLE, 6) AS share FROM g GROUP BY item_id""")
def f29_bigrams(t: Tables):
    x = t.benchmark.select("item_id", F.col("text").alias("e")).join(t.documents.select("doc_id", F.col("text").alias("a")), F.col("item_id") == F.col("doc_id"))
    return x.select("item_id", F.round(T.bigram_share("e", "a"), 6).alias("share"))


@C.add("SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, regexp_matches(url, '^https?://[^\\s/?#]+') AS valid FROM pages")
def f31_url_parts(t: Tables):
    return t.pages.select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"), T.valid_url("url").alias("valid"))


@C.add("SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[?#].*$', ''), '\\.html?$', '') AS title FROM pages")
def f14_filename_title(t: Tables):
    return t.pages.select("page_id", F.regexp_replace(F.regexp_replace(F.regexp_extract("url", "([^/]*)$", 1), r"[?#].*$", ""), r"\.html?$", "").alias("title"))


@C.add("SELECT doc_id, len(list_filter(list_transform(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+$'), lambda x: trim(x)), lambda x: x <> '')) AS sentences FROM documents")
def f25_sentences(t: Tables):
    return t.documents.select("doc_id", F.size(T.sentences("text")).cast("long").alias("sentences"))


# Sources
@C.add(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(x) <> '')) AS paragraphs FROM documents")
def s11_paragraphs(t: Tables):
    return t.documents.select("doc_id", F.size(structure.paragraphs(F.col("text"))).cast("long").alias("paragraphs"))


@C.add()
def s12_html_text(t: Tables):
    return t.pages.select("page_id", files.html_text_nodes("html").alias("text"))


# Structure
@C.add(rf"""WITH {LINES} SELECT doc_id, block_seq, CASE WHEN trim(text) LIKE '|%' THEN 'table' WHEN regexp_matches(trim(text), '\.{{4,}}') THEN 'text' WHEN regexp_matches(trim(text), '^\d+[.]\d+') THEN 'subitem' WHEN regexp_matches(trim(text), '^[(]\d+[)]') THEN 'item' WHEN regexp_matches(trim(text), '^\d+[.]') THEN 'subitem' WHEN length(trim(text)) <= 36 AND trim(text) <> '' AND NOT regexp_matches(trim(text), '[.!?;,]$') THEN 'heading' ELSE 'text' END AS kind FROM b""")
def d1_block_types(t: Tables):
    return structure.blocks_of(t.documents).select("doc_id", _long("block_seq"), structure.classify(F.col("text"))["kind"].alias("kind"))


@C.add()
def d3_hierarchy(t: Tables):
    return structure.with_hierarchy(structure.blocks_of(t.documents)).select("doc_id", _long("block_seq"), "kind", "section_path")


@C.add(rf"WITH {LINES}, e AS (SELECT *, regexp_matches(text, '(?:\.{{2,}})\s*\d+\s*$') AS entry FROM b) SELECT doc_id, block_seq FROM (SELECT *, sum(entry::INT) OVER (PARTITION BY doc_id) AS n FROM e) WHERE NOT (n >= 3 AND entry)")
def d20_toc_filter(t: Tables):
    return structure.without_toc(structure.blocks_of(t.documents)).select("doc_id", _long("block_seq"))


@C.add(rf"""WITH {LINES}, w AS (SELECT *, CASE WHEN trim(text) LIKE '|%' OR text LIKE '% | %' THEN len(string_split(text, '|')) END AS width FROM b),
 i AS (SELECT *, sum(CASE WHEN coalesce(lag_w = width, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY block_seq) AS island FROM (SELECT *, lag(width) OVER (PARTITION BY doc_id ORDER BY block_seq) AS lag_w FROM w))
 SELECT doc_id, width::BIGINT AS width, min(block_seq) AS block_seq, count(*) AS rows FROM i WHERE width IS NOT NULL GROUP BY doc_id, island, width""")
def d24_stitch(t: Tables):
    return structure.stitch_tables(structure.blocks_of(t.documents)).select("doc_id", _long("width"), _long("block_seq"), "rows")


@C.add(rf"""WITH {LINES}, g AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY block_seq) AS p FROM b),
 i AS (SELECT *, sum(CASE WHEN coalesce(regexp_matches(p, '[^.!?:\s]\s*$') AND regexp_matches(text, '^\p{{Ll}}'), false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY block_seq) AS island FROM g)
 SELECT doc_id, min(block_seq) AS block_seq, count(*) AS merged, md5(string_agg(text, ' ' ORDER BY block_seq)) AS h FROM i GROUP BY doc_id, island""")
def d25_merge(t: Tables):
    return structure.merge_open_lines(structure.blocks_of(t.documents)).select("doc_id", _long("block_seq"), "merged", F.md5(F.col("text").cast("binary")).alias("h"))


@C.add()
def d8_unit_pack(t: Tables):
    return chunker.chunk_documents(t.documents).select("doc_id", "chunk_index", "chunk_id", "character_count", "is_oversized", "overlap_from")


@C.add(r"""WITH d AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS t FROM documents) SELECT doc_id, length(t)::BIGINT AS characters, true AS within FROM d WHERE t <> ''""")
def d5_split_is_lossless(t: Tables):
    """The chunks of a document hold all of its characters, and none is over the limit unless it is marked."""
    c = chunker.chunk_documents(t.documents)
    return c.groupBy("doc_id").agg(F.sum("character_count").alias("characters"), F.bool_and((F.col("character_count") <= structure.MAX_CHARS) | F.col("is_oversized")).alias("within"))


@C.add()
def d10_overlap(t: Tables):
    """Chunks that need the one before them, why, and what of it they carry."""
    return chunker.chunk_documents(t.documents).where("overlap_reason <> ''").select("doc_id", "chunk_index", "overlap_reason", "overlap_from", "overlap_text", "parent_context")


@C.add(r"SELECT doc_id, source AS prefix FROM documents WHERE trim(text) <> ''")
def d13_context_prefix(t: Tables):
    """The source stands for the title; it is named in no text, so each document's first chunk gets it."""
    c = chunker.chunk_documents(t.documents, title_col="source").where("chunk_index = 1")
    return c.select("doc_id", F.split("context_prefix", " / ")[0].alias("prefix"))


@C.add()
def d6_sentence_pack(t: Tables):
    return chunker.chunk_documents(t.documents, most=400).select("doc_id", "chunk_index", "character_count")


# Quality, over documents as chunks of their source
def _chunks(t: Tables):
    return t.documents.select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("document_id"), F.col("doc_id").alias("chunk_index"), F.col("text").alias("body_text"), "text",
        F.lit("").alias("title"), (F.col("n_chars") > 5000).alias("is_oversized"), F.lit("").alias("overlap_source_chunk_id"),
    )


QUALITY = r"""c AS (SELECT doc_id::VARCHAR AS chunk_id, source AS document_id, doc_id AS chunk_index, text AS body_text, n_chars > 5000 AS ov, regexp_replace(text, '\s+', '', 'g') AS k FROM documents),
i AS (
 SELECT 'character_limit' AS "check", 'critical' AS severity, document_id, chunk_id FROM c WHERE length(k) > 1200 AND NOT ov
 UNION ALL SELECT 'empty_chunk', 'critical', document_id, chunk_id FROM c WHERE length(k) = 0
 UNION ALL SELECT 'marked_oversized', 'minor', document_id, chunk_id FROM c WHERE length(k) > 0 AND ov
 UNION ALL SELECT 'very_short_chunk', 'minor', document_id, chunk_id FROM c WHERE length(k) > 0 AND length(k) < 80
 UNION ALL SELECT 'orphan_list_item', 'minor', document_id, chunk_id FROM c WHERE length(k) > 0 AND length(k) < 80 AND regexp_matches(body_text, '^\s*(?:[(]\d+[)]|\d+[.])')
 UNION ALL SELECT 'page_number_residue', 'major', document_id, chunk_id FROM c WHERE len(list_filter(string_split(body_text, chr(10)), lambda x: regexp_matches(x, '(?i)^\s*(?:-\s*\d+\s*-|\d+\s*/\s*\d+)\s*$'))) > 0
 UNION ALL SELECT 'table_of_contents_residue', 'critical', document_id, chunk_id FROM c WHERE len(regexp_extract_all(body_text, '(?:\.{4,})\s*\d+')) >= 2
 UNION ALL SELECT 'duplicate_chunk_body', 'major', document_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id, k ORDER BY chunk_index) AS n FROM c WHERE length(k) >= 50) WHERE n > 1
 UNION ALL SELECT 'chunk_order', 'critical', document_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) AS n FROM c) WHERE n <> chunk_index
 UNION ALL SELECT 'incomplete_enumeration', 'major', document_id, chunk_id FROM (SELECT *, lead(body_text) OVER (PARTITION BY document_id ORDER BY chunk_index) AS nx FROM c) WHERE regexp_matches(body_text, ':\s*$') AND regexp_matches(nx, '^\s*(?:[(]\S{1,3}[)]|\d+[.])'))"""


@C.add(f"""WITH {QUALITY} SELECT "check", severity, document_id, chunk_id FROM i""")
def q_all_issues(t: Tables):
    return quality.all_issues(_chunks(t))


@C.add(f"""WITH {QUALITY} SELECT "check", count(*) AS issues, count(CASE WHEN severity IN ('critical', 'major') THEN 1 END) = 0 AS passed FROM i GROUP BY "check" """)
def q_checks(t: Tables):
    return quality.check_summary(quality.all_issues(_chunks(t)))


@C.add(f"""WITH {QUALITY}, w AS (SELECT chunk_id, max(CASE severity WHEN 'critical' THEN 3 WHEN 'major' THEN 2 ELSE 1 END) AS w, count(*) AS n FROM i GROUP BY chunk_id) SELECT c.chunk_id, c.document_id, CASE w WHEN 3 THEN 'needs_fix' WHEN 2 THEN 'needs_manual_review' ELSE 'pass' END AS status, coalesce(n, 0) AS issues FROM c LEFT JOIN w USING (chunk_id)""")
def q_review_status(t: Tables):
    chunks = _chunks(t)
    return quality.review_status(chunks, quality.all_issues(chunks))


# Citations: each item quotes documents of the same id
@C.add("SELECT b.item_id AS answer_id, b.item_id AS evidence_id, CASE WHEN d.doc_id IS NULL THEN 'unknown_id' WHEN contains(d.text, left(b.text, 60)) THEN 'exact' ELSE 'other' END AS status FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id * 20")
def c1_citation_check(t: Tables):
    basis = t.benchmark.select(F.col("item_id").alias("answer_id"), F.col("item_id").alias("evidence_id"), F.left("text", F.lit(60)).alias("quote"))
    wanted = t.benchmark.select(F.col("item_id").alias("evidence_id"), (F.col("item_id") * 20).alias("doc_id")).distinct()
    hits = t.documents.join(wanted, "doc_id").select("evidence_id", "text")
    found = citation.validate_citations(basis, hits)
    return found.select("answer_id", "evidence_id", F.when(F.col("status").isin("exact", "unknown_id"), F.col("status")).otherwise("other").alias("status"))


@C.add()
def c2_quote_align(t: Tables):
    """Every document quotes its first line in upper case with other spaces: alignment finds the source's words."""
    basis = t.documents.select(F.col("doc_id").alias("answer_id"), F.col("doc_id").alias("evidence_id"), F.upper(F.regexp_replace(T.latin_lead("text"), " ", "  ")).alias("quote"))
    return citation.validate_citations(basis, t.documents.select(F.col("doc_id").alias("evidence_id"), "text"))


# Labels; stand-in rules from the tables' own words
RULES = [("topic", 0, "licence", "[Ll]icen[sc]e", "names a licence"), ("topic", 1, "rights", "rights reserved", "reserves rights"), ("topic", 2, "contact", "@", "an address"), ("language", 0, "german", "ung|keit", "suffixes"), ("language", 1, "english", "ing|tion", "suffixes")]
_SCORES = "s AS (SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT doc_id, '{d}' AS dimension, {k} AS rule_no, '{label}' AS label, len(regexp_extract_all(text, '{p}')) AS matches, least(len(regexp_extract_all(text, '{p}')), 20) + CASE WHEN regexp_matches(regexp_extract(text, '^([^\\n]*)', 1), '{p}') THEN 50 ELSE 0 END + CASE WHEN regexp_matches(left(text, 1000), '{p}') THEN 12 ELSE 0 END AS score FROM documents"
    for d, k, label, p, _ in RULES
) + ") WHERE score >= 2 AND matches > 0)"


def _scores(t: Tables):
    return classification.rule_scores(t.documents.select("doc_id", T.latin_lead("text").alias("title"), F.left("text", F.lit(1000)).alias("head"), "text"), RULES)


@C.add(f"WITH {_SCORES} SELECT doc_id, dimension, rule_no, label, matches, score FROM s")
def l2_rule_scores(t: Tables):
    return _scores(t).select("doc_id", "dimension", "rule_no", "label", "matches", "score")


@C.add(f"WITH {LINES} " + " UNION ALL ".join(f"SELECT doc_id, '{d}' AS dimension, {k} AS rule_no, min(block_seq) AS block_seq FROM b WHERE regexp_matches(text, '{p}') GROUP BY doc_id" for d, k, _, p, _ in RULES))
def l3_first_evidence(t: Tables):
    return classification.first_evidence(structure.blocks_of(t.documents), RULES).drop("at")


@C.add(f"WITH {_SCORES}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, dimension ORDER BY score DESC, matches DESC, rule_no DESC) AS k FROM s) WHERE k = 1) SELECT d.doc_id, w.dimension, coalesce(t.label, w.fb) AS label, t.label IS NULL AS needs_review FROM documents d CROSS JOIN (VALUES ('topic', 'general'), ('language', 'other')) w(dimension, fb) LEFT JOIN t ON t.doc_id = d.doc_id AND t.dimension = w.dimension")
def l4_defaults(t: Tables):
    return classification.with_defaults(t.documents, classification.top_labels(_scores(t), 1), {"topic": "general", "language": "other"})


# Grading: an assistant's turn answers the user's turn before it; the truth is the same turn's first line
@C.add()
def e9_verdict(t: Tables):
    a = t.conversations.where("role = 'assistant'").select((F.col("conv_id") * 100 + F.col("turn")).alias("question_id"), F.lit("can it be").alias("question"), T.latin_lead("text").alias("truth"), F.col("text").alias("answer"))
    return evaluation.judge_answers(a)


@C.add("SELECT conv_id * 100 + turn AS question_id, CASE WHEN text = '' THEN 'no_answer' WHEN contains(lower(text), 'insufficient') THEN 'insufficient' ELSE 'answered' END AS status FROM conversations")
def e10_lifecycle(t: Tables):
    a = t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("question_id"), F.lit(None).cast("string").alias("error"), F.col("text").alias("answer"))
    return evaluation.lifecycle(a).select("question_id", "status")


@C.add()
def x1_session_fsm(t: Tables):
    """Recorded turns as events: users reply, assistants go through the tools by the length of their text."""
    tool = F.element_at(F.array(*(F.lit(x) for x in ("rewrite", "search", "answer", "save", "confirm"))), (F.length("text") % 5 + 1).cast("int"))
    e = t.conversations.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.when(F.col("role") == "user", "user").otherwise(tool).alias("event"), (F.length("text") % 2 == 0).alias("ok"))
    return sessions.run_sessions(e)
