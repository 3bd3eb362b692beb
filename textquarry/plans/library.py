"""Queries through the corpus operators, checked by the SQL of ``relational`` or by their own."""
from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.functions import numbers
from textquarry.functions import text as T
from textquarry.operators import corpus as O
from textquarry.operators import classification, review, structure

from . import relational
from .base import Catalogue, Tables

C = Catalogue()
SQL = relational.C.oracles


def _as(name: str):
    """The operator's query for a name of ``relational``, whose SQL checks it."""
    return C.add(SQL[name], name)


def _lines(t: Tables):
    return structure.blocks_of(t.documents).select("doc_id", F.col("block_seq").cast("long").alias("line_no"), F.col("text").alias("line"))


# Aggregations
@_as("a1_document_rollup")
def a1(t):
    return O.rollup(t.documents, "source", "n_chars", "text", "doc_id")


@_as("a3_document_frequency")
def a3(t):
    terms = t.documents.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(T.LATIN_TOKEN), F.lit(0))).alias("term"))
    return O.document_frequency(terms, "doc_id", 2)


_KEY = r"sha256(regexp_replace(text, '\s+', '', 'g'))"


def _body_key():
    return F.sha2(T.compact("text"), 256)


@C.add(f"WITH k AS (SELECT doc_id, source, {_KEY} AS key FROM documents), g AS (SELECT key, count(*) AS n, CASE WHEN count(DISTINCT source) > 1 THEN 'review' ELSE 'overlap' END AS status FROM k GROUP BY key HAVING count(*) > 1) SELECT key, n, status, doc_id FROM k JOIN g USING (key)")
def a6_duplicate_audit(t: Tables):
    return O.duplicate_members(t.documents, _body_key(), "source", "doc_id")


@C.add(r"SELECT conv_id, sha256(string_agg(sha256(regexp_replace(text, '\s+', '', 'g')), '' ORDER BY turn)) AS body_hash FROM conversations GROUP BY conv_id")
def a7_body_hash(t: Tables):
    return O.body_hash(t.conversations, "conv_id", "turn", "text")


@_as("a8_audit_summary")
def a8(t):
    return O.audit_summary(O.duplicate_groups(t.documents, _body_key(), "source"))


@_as("a11_length_stats")
def a11(t):
    return O.length_stats(t.documents, "lang", "n_chars", 1200)


TOPICS = {"the": ("the", "and"), "de": ("de", "la"), "ung": ("ung", "und"), "ción": ("ción",)}
_N = {k: " + ".join(f"(length(text) - length(replace(text, '{w}', ''))) // {len(w)}" for w in ws) for k, ws in TOPICS.items()}
_MOST = f"greatest({', '.join(f'n{k}' for k in range(len(TOPICS)))})"


@C.add(f"SELECT doc_id, {', '.join(f'n{k}' for k in range(len(TOPICS)))}, CASE WHEN {_MOST} = 0 THEN '' {' '.join(f'WHEN n{k} = {_MOST} THEN {name!r}' for k, name in enumerate(TOPICS))} END AS topic FROM (SELECT doc_id, {', '.join(f'({n})::BIGINT AS n{k}' for k, n in enumerate(_N.values()))} FROM documents)")
def a12_topic_scores(t: Tables):
    scores, best = O.topic_scores(F.col("text"), TOPICS)
    return t.documents.select("doc_id", *(c.alias(f"n{k}") for k, c in enumerate(scores.values())), best.alias("topic"))


@C.add("""WITH l AS (SELECT source, doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents), e AS (SELECT source, doc_id, unnest(list_distinct(ls[1:2] || ls[-2:])) AS line FROM l),
 p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM documents GROUP BY source)
 SELECT source, line, n FROM (SELECT source, line, count(DISTINCT doc_id) AS n FROM e GROUP BY source, line) JOIN p USING (source) WHERE n >= CASE WHEN pages <= 5 THEN 2 ELSE greatest(3, (pages + 2) // 3) END""")
def a14_repeated_margins(t: Tables):
    """Each document is a page of its source."""
    return O.margin_lines(t.documents, "source", "doc_id", "text")


@_as("a15_verdict_pivot")
def a15(t):
    verdict = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "correct").otherwise("partial")
    judged = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").select("source", verdict.alias("verdict"))
    return O.verdict_pivot(judged, "source", ("correct", "partial", "rejected"))


@_as("a16_tag_counts")
def a16(t):
    return O.tag_counts(t.documents, "doc_id", {"lang": F.col("lang"), "source": F.col("source"), "size": F.when(F.col("n_chars") > 5000, "long").otherwise("short")})


@_as("a19_shared_text")
def a19(t):
    return O.shared_texts(t.documents, "text", "source")


@C.add("SELECT CASE WHEN n_chars >= 1000 THEN 'A' ELSE 'B' END AS level, count(*) AS n FROM documents GROUP BY 1")
def a22_level_counts(t: Tables):
    return O.level_counts(t.documents, F.when(F.col("n_chars") >= 1000, "A").otherwise("B"))


@_as("a23_smoke_report")
def a23(t):
    return O.outcome_counts(t.labels, F.col("quality") == 1)


@_as("a24_distinct_tags")
def a24(t):
    return O.distinct_tags(t.documents, "lang", "source").withColumnRenamed("tags", "sources")


# Joins
@_as("j3_duplicate_key_guard")
def j3(t):
    return O.repeated_keys(t.part, "p_brand")


@C.add("SELECT l_orderkey, l_linenumber::BIGINT AS line, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def j4_referenced(t: Tables):
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("long").alias("line"))
    return O.referenced(lines, t.orders.select("o_orderkey", "o_custkey"), "o_orderkey").withColumnRenamed("o_orderkey", "l_orderkey")


@_as("j7_full_outer_merge")
def j7(t):
    return O.merged_lists(t.labels.where("toxic = 1").select("doc_id", "quality"), t.documents.where("n_chars > 3000").select("doc_id", "n_chars"), "doc_id")


@_as("j12_composite_fallback")
def j12(t):
    customers = t.customer.select(F.col("c_custkey").alias("o_custkey"))
    met = O.composite_match(customers, t.orders.select("o_custkey", "o_orderstatus", "o_orderkey"), "o_custkey", F.lit("F"), "o_orderstatus", "o_orderkey")
    return met.select(F.col("o_custkey").alias("c_custkey"), F.col("match_id").alias("order_key"), "how")


@C.add("SELECT DISTINCT conv_id AS answer_id, turn AS doc_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.turn) AS known FROM conversations c")
def j16_wiki_basis(t: Tables):
    """Every turn number is cited as a note's id; the labelled ids are active."""
    known, unknown = O.known_basis(t.conversations.select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("doc_id")), t.labels.select("doc_id"), "doc_id")
    return known.withColumn("known", F.lit(True)).unionByName(unknown.withColumn("known", F.lit(False)))


@_as("j17_vector_reuse")
def j17(t):
    old = t.documents.where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 10 == 0, F.md5(F.concat("text", F.lit("!")))).otherwise(F.md5("text")).alias("hash"))
    return O.reuse(t.documents.select("doc_id", F.md5("text").alias("hash")), old, "doc_id").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@C.add("SELECT s_suppkey AS id, (SELECT min(c_custkey) FROM customer WHERE replace(c_name, 'Customer', '') = replace(s_name, 'Supplier', '')) AS current_id FROM supplier")
def j18_carried_over(t: Tables):
    """Suppliers are the baseline, customers of the same number its successors."""
    return O.carried_over(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title")), t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title")), F.regexp_replace("title", "^(?:Customer|Supplier)", "")).select("id", "current_id")


# Order
@_as("w3_dup_suffix")
def w3(t):
    return O.suffixed(_lines(t), "doc_id", F.substring("line", 1, 3), "line_no").select("doc_id", "line_no", "id")


@_as("w4_monotonic")
def w4(t):
    return O.never_falling(t.orders, "o_custkey", "o_orderkey", "o_totalprice").select("o_custkey", "o_orderkey", "o_totalprice")


@_as("w5_section_path")
def w5(t):
    return _lines(t).select("doc_id", "line_no", O.carried_forward("doc_id", "line_no", F.when(F.length("line") <= 30, F.col("line_no"))).alias("section_line"))


@_as("w6_contiguity")
def w6(t):
    lines = t.lineitem.where("l_returnflag <> 'R'").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))
    return O.out_of_sequence(lines, "l_orderkey", "l_linenumber")


@_as("w7_neighbour")
def w7(t):
    each = _lines(t).withColumn("next_length", O.following("doc_id", "line_no", F.length("line").cast("long")))
    return each.where(F.col("line").endswith(",") | (F.col("next_length") < 10)).drop("line")


@_as("w8_order_regression")
def w8(t):
    return O.regressions(t.orders, "o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus").select("o_custkey", "o_orderkey")


@_as("w9_gaps")
def w9(t):
    return O.runs(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey", 1000).withColumn("run", F.col("run").cast("long"))


@_as("w10_offsets")
def w10(t):
    return structure.offsets(structure.blocks_of(t.documents)).select("doc_id", F.col("block_seq").cast("long").alias("line_no"), "start_char")


@_as("w11_sticky_flag")
def w11(t):
    return _lines(t).select("doc_id", "line_no", O.since("doc_id", "line_no", F.length("line") < 20).alias("after_heading"))


@_as("w16_latest_n")
def w16(t):
    return O.top(t.conversations, "conv_id", [F.col("turn").desc()], 3).select("conv_id", "turn", F.col("rn").cast("long").alias("rn"))


@_as("w17_prev_user")
def w17(t):
    return t.conversations.select("conv_id", "turn", O.last_before("conv_id", "turn", F.when(F.col("role") == "user", F.col("turn"))).alias("user_turn"))


@_as("w18_caption")
def w18(t):
    each = _lines(t).withColumn("c", O.caption("doc_id", "line_no", F.col("line"), 100)).where(F.contains("line", F.lit("|")) & F.col("c").isNotNull())
    return each.select("doc_id", "line_no", F.md5("c").alias("caption"))


# Sorts and sets
@_as("t6_top_cap")
def t6(t):
    return O.top(t.documents, "source", [F.col("n_chars").desc(), F.col("doc_id").desc()], 5).select("source", "doc_id", "n_chars", F.col("rn").cast("long").alias("rn"))


@_as("t7_priority_sort")
def t7(t):
    first = [(F.col("source") == s, F.substring("text", 1, 20)) for s in ("src3", "src1")]
    return O.prioritised(t.documents, "lang", first, "doc_id").select("doc_id", "position")


@_as("t8_missing_last")
def t8(t):
    rank = F.when(F.col("o_orderpriority").startswith("1"), 1).when(F.col("o_orderpriority").startswith("2"), 2)
    return O.missing_last(t.orders, "o_custkey", rank, "o_orderkey").select("o_orderkey", "position")


@C.add("SELECT doc_id, min(src)::INTEGER AS src FROM (SELECT doc_id, 0 AS src FROM labels UNION ALL SELECT doc_id, 1 FROM documents) GROUP BY doc_id")
def u2_ordered_union(t: Tables):
    return O.ordered_union([t.labels, t.documents], "doc_id")


@_as("u4_array_except")
def u4(t):
    return O.set_difference(t.documents, "source", t.labels, "doc_id")


@_as("u5_exact_set")
def u5(t):
    return O.exact_set(t.documents, t.labels, "doc_id")


@C.add("SELECT 's' || s_suppkey AS id, s_nationkey AS nation FROM supplier UNION ALL SELECT 'c' || c_custkey, c_nationkey FROM customer")
def u6_union_unique(t: Tables):
    part = lambda df, c: df.select(F.concat(F.lit(c), F.col(df.columns[0]).cast("string")).alias("id"), F.col(f"{c}_nationkey").alias("nation"))
    return O.union_unique([part(t.supplier, "s"), part(t.customer, "c")], "id")


@_as("u8_delete_reindex")
def u8(t):
    return O.reindexed(t.documents.where(~((F.col("lang") == "de") & (F.col("n_chars") < 500))), "source", "doc_id").select("source", "doc_id", "row_index")


@_as("u9_upsert")
def u9(t):
    return O.upserted(t.documents, t.labels, "doc_id", "quality", F.lit(-1)).select("doc_id", "quality", "status")


# Projections
@C.add("SELECT doc_id, md5(array_to_string(list_filter([source, lang, source, text], lambda x: x IS NOT NULL AND x <> ''), chr(10))) AS h FROM documents")
def p1_search_text(t: Tables):
    return t.documents.select("doc_id", F.md5(O.search_text(["source", "lang", "source", "text"])).alias("h"))


@C.add("SELECT doc_id, coalesce(lang, 'und') AS lang, source, 'reviewed' AS status FROM documents")
def p2_corpus_projection(t: Tables):
    return O.with_defaults(t.documents.select("doc_id", "lang", "source"), {"lang": F.lit("und"), "status": F.lit("reviewed")})


@C.add("SELECT o_custkey, o_orderkey, c_name AS title, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::BIGINT AS place FROM orders JOIN customer ON o_custkey = c_custkey")
def p5_refresh(t: Tables):
    rows = t.orders.select("o_custkey", "o_orderkey", F.lit("old").alias("title"), F.col("o_orderkey").alias("chunk_index"))
    fields = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("title"))
    return O.refreshed(rows, fields, "o_custkey").select("o_custkey", "o_orderkey", "title", F.col("chunk_index").cast("long").alias("place"))


@C.add("SELECT p_partkey, p_name FROM part WHERE contains(p_name, '1') ORDER BY p_name LIMIT 50")
def p7_named_like(t: Tables):
    """A limit is what this operator is asked for."""
    return O.named_like(t.part.select("p_partkey", "p_name"), "p_name", "1", 50)


@C.add("SELECT page_id FROM pages WHERE NOT starts_with(coalesce(regexp_extract(url, '^https?://([^/:?#]+)', 1), ''), 'www.')")
def p8_without_excluded(t: Tables):
    return O.without_excluded(t.pages.withColumn("host", F.regexp_extract("url", "^https?://([^/:?#]+)", 1)), "host", "www.").select("page_id")


@C.add("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def p9_selected(t: Tables):
    return O.selected(t.documents.select("doc_id", "source"), "doc_id", t.labels)


@C.add("SELECT event_id, (row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id))::BIGINT AS position FROM events WHERE event_type = (SELECT min(event_type) FROM events)")
def p11_newest(t: Tables):
    first = t.events.agg(F.min("event_type")).first()[0]
    return O.newest(t.events, "event_type", first, "ts", "event_id").select("event_id", F.col("position").cast("long").alias("position"))


@C.add("SELECT conv_id, count(*) FILTER (role = 'user') AS kept FROM conversations GROUP BY conv_id")
def p12_only_cited(t: Tables):
    hits = t.conversations.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("hits"), F.collect_set(F.when(F.col("role") == "user", F.col("turn"))).alias("cited"))
    return hits.select("conv_id", F.size(O.only_cited(F.col("hits"), F.col("cited"), "turn")).cast("long").alias("kept"))


# Index gates, queries, numbers
@C.add("SELECT count(*) AS rows, true AS same FROM documents")
def r9_fingerprint_gate(t: Tables):
    """The fingerprint is the same from any order and partitioning of the rows."""
    a = O.input_fingerprint(t.documents, "doc_id", F.col("text"))
    # Digests are dealt anew, not texts, and by more than the few sources.
    digests = O.row_digests(t.documents, "doc_id", F.col("text"), "source")
    b = O.fingerprint(digests.repartition("source", "doc_id").sortWithinPartitions(F.col("doc_id").desc()))
    return a.join(b.withColumnRenamed("fingerprint", "other"), "rows").select("rows", (F.col("fingerprint") == F.col("other")).alias("same"))


@C.add("SELECT doc_id, sum(length(text))::BIGINT AS total FROM documents GROUP BY doc_id")
def r11_incremental_embedding(t: Tables):
    """Vectors of labelled documents are kept, the others made anew, by lengths in place of a model."""
    now = t.documents.select("doc_id", F.md5("text").alias("hash"), "text")
    vector = lambda df: df.withColumn("vector", F.array(F.length("text").cast("float")))
    before = vector(now.join(t.labels.select("doc_id"), "doc_id")).select("doc_id", "hash", "vector")
    return O.embedded(now, before, "doc_id", vector).select("doc_id", F.col("vector")[0].cast("long").alias("total"))


@C.add("SELECT doc_id, source || ',' || coalesce(lang, '') || CASE WHEN lang = 'de' THEN ',german,deutsch' ELSE '' END AS terms FROM documents")
def f40_expanded_terms(t: Tables):
    terms = O.expanded_terms(F.array("source", F.coalesce("lang", F.lit(""))), [("^de$", ("german", "deutsch"))])
    return t.documents.select("doc_id", F.array_join(terms, ",").alias("terms"))


@C.add("SELECT item_id, 2::BIGINT AS keyword, 2::BIGINT AS semantic, md5(text || ' ' || text) AS h FROM benchmark")
def f41_channel_queries(t: Tables):
    q = t.benchmark.select("item_id", "text", O.channel_queries(F.array("text", "text"), F.array(F.lit("scope"))).alias("q"))
    return q.select("item_id", F.size("q.keyword").cast("long").alias("keyword"), F.size("q.semantic").cast("long").alias("semantic"), F.md5(F.get("q.semantic", F.lit(0))).alias("h"))


@C.add("SELECT l_orderkey, l_linenumber::BIGINT AS line, rtrim(rtrim(printf('%.8f', l_extendedprice), '0'), '.') AS price FROM lineitem")
def f24_format_number(t: Tables):
    return t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), numbers.format_number("l_extendedprice").alias("price"))


@C.add("SELECT conv_id, turn, CASE WHEN turn > 0 THEN 'p. ' || turn || ' / ' ELSE '' END || role || ' / block ' || conv_id AS locator FROM conversations")
def f36_locator(t: Tables):
    return t.conversations.select("conv_id", "turn", O.locator(F.col("turn"), F.col("role"), F.col("conv_id")).alias("locator"))


@C.add("SELECT conv_id, turn, role <> 'system' AND turn < max(turn) OVER (PARTITION BY conv_id, role) AS superseded FROM conversations")
def x5_superseded(t: Tables):
    return O.latest_versions(t.conversations, ["conv_id", "role"], "turn", F.col("role") == "system").select("conv_id", "turn", "superseded")


@C.add("SELECT event_id, CASE WHEN s >= 500 OR s = 429 THEN CASE WHEN a < 3 THEN least(pow(2, a - 1), 5)::DOUBLE END END AS seconds FROM (SELECT event_id, user_id % 4 + 1 AS a, CASE event_id % 3 WHEN 0 THEN 429 WHEN 1 THEN 503 ELSE 200 END AS s FROM events)")
def x9_retry_delay(t: Tables):
    status = F.element_at(F.array(*map(F.lit, (429, 503, 200))), (F.col("event_id") % 3 + 1).cast("int"))
    return t.events.select("event_id", O.retry_delay(F.col("user_id") % 4 + 1, status, F.lit(None).cast("double")).alias("seconds"))


@C.add("SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM labels)")
def e11_pending(t: Tables):
    return O.pending(t.benchmark.select("item_id"), t.labels.select(F.col("doc_id").alias("item_id")), "item_id")


@C.add("SELECT d.doc_id, 'n_chars' AS field FROM documents d JOIN labels l USING (doc_id) WHERE d.n_chars <> l.quality")
def q31_metadata_mismatch(t: Tables):
    """Two of three fields agree with themselves, the third is compared with another table's."""
    other = t.labels.join(t.documents.select("doc_id", "lang", "source"), "doc_id").select("doc_id", "lang", "source", F.col("quality").cast("long").alias("n_chars"))
    return O.mismatches(t.documents, other, "doc_id", ("lang", "source", "n_chars"))


@C.add("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def k10_stale_artifacts(t: Tables):
    return O.pending(t.documents.select("doc_id"), t.labels, "doc_id")


# Review
def _documents_as_chunks(t: Tables):
    return t.documents.select(F.col("source").alias("document_id"), F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("chunk_index"), F.col("text").alias("body_text"))


_RULES = {"noise_markup": ("major", "</?(?:p|div|span|table|tr|td)\\b[^>]*>"), "noise_leader_dots": ("major", "\\.{6,}|…{3,}"), "noise_blank_form": ("major", "_{6,}"), "noise_repeated_sign": ("major", "!{10,}|[?]{10,}|[*]{10,}|#{10,}|={10,}|~{10,}|-{10,}"), "noise_replacement_character": ("critical", "�"), "noise_control_character": ("critical", "[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F]"), "noise_field_code": ("critical", "(?i)\\b(?:PAGEREF|MERGEFIELD|SEQ Table)\\b")}


@C.add(" UNION ALL ".join(f"""SELECT '{name}' AS "check", '{severity}' AS severity, source AS document_id, doc_id AS chunk_id FROM documents WHERE regexp_matches(text, '{pattern}')""" for name, (severity, pattern) in _RULES.items()))
def q33_noise(t: Tables):
    return review.noise(_documents_as_chunks(t))


@C.add("""SELECT 'possible_split_enumeration' AS "check", 'minor' AS severity, document_id, chunk_id FROM (SELECT conv_id AS document_id, conv_id * 1000 + turn AS chunk_id, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations) WHERE regexp_matches(text, '[;,]\\s*$') AND regexp_matches(nx, '^\\s*(?:[(]\\s*\\d{1,3}\\s*[)]|\\d{1,3}[.])')""")
def q22_split_enumeration(t: Tables):
    c = t.conversations.select(F.col("conv_id").alias("document_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), F.col("turn").alias("chunk_index"), F.col("text").alias("body_text"))
    return review.split_enumerations(c)


@C.add(r"""SELECT 'duplicate_in_document' AS "check", 'minor' AS severity, document_id, chunk_id FROM (SELECT source AS document_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY source, regexp_replace(text, '\s+', '', 'g') ORDER BY doc_id) AS n FROM documents WHERE length(regexp_replace(text, '\s+', '', 'g')) >= 50) WHERE n > 1""")
def q34_repeated_bodies(t: Tables):
    return review.repeated_bodies(_documents_as_chunks(t))


@C.add("""SELECT 'missing_structured_document' AS "check", 'critical' AS severity, doc_id AS document_id, doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def q29_unknown_sources(t: Tables):
    """Labelled documents are stored; each chunk names its document's first block."""
    chunks = t.documents.select(F.col("doc_id").alias("document_id"), F.col("doc_id").alias("chunk_id"), F.array(F.lit(0)).alias("block_ids"))
    stored = t.labels.select(F.col("doc_id").alias("document_id")).distinct()
    return review.unknown_sources(chunks, stored, stored.withColumn("block_seq", F.lit(0)))


@C.add("""SELECT d.doc_id, 'quality' AS dimension, CASE WHEN l.quality = 1 THEN 'good' WHEN d.lang IS NOT NULL THEN d.lang ELSE 'none' END AS label, CASE WHEN l.quality = 1 THEN 'A' WHEN d.lang IS NOT NULL THEN 'B' ELSE '' END AS level, l.quality IS DISTINCT FROM 1 AND d.lang IS NULL AS needs_review FROM documents d LEFT JOIN labels l USING (doc_id)""")
def l5_carried_labels(t: Tables):
    """Labels of good quality are a rule's, the languages are the baseline's."""
    own = t.labels.where("quality = 1").select("doc_id", F.lit("quality").alias("dimension"), F.lit("good").alias("label"))
    return classification.carried_labels(own, t.documents.select("doc_id", F.lit("quality").alias("dimension"), F.col("lang").alias("label")), {"quality": "none"})
