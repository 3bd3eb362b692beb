"""Aggregations, joins, windows, sets and sorts as SQL over the tables; one text for both engines where dialects agree.

``library`` has the operators for most of them; there the SQL here is the check.
"""
from __future__ import annotations

from .base import Catalogue

C = Catalogue()

# Aggregations
C.sql("a1_document_rollup", """SELECT source AS document_id, count(*) AS chunk_count, CAST(sum(CASE WHEN coalesce(n_chars, 0) = 0 THEN length(text) ELSE n_chars END) AS BIGINT) AS character_count, min(doc_id) AS first_id FROM {documents} GROUP BY source""")
C.sql("a3_document_frequency", """SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, explode(regexp_extract_all(lower(text), '[a-z0-9]+(?:[._/-][a-z0-9]+)*', 0)) AS term FROM {documents}) GROUP BY term HAVING count(*) > 1""",
      """SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:[._/-][a-z0-9]+)*')) AS term FROM documents) GROUP BY term HAVING count(*) > 1""")
_KEY_S, _KEY_D = r"sha2(regexp_replace(text, '(?U)\\s+', ''), 256)", r"sha256(regexp_replace(text, '\s+', '', 'g'))"
C.sql("a8_audit_summary", f"""SELECT count(*) AS groups, count(CASE WHEN s > 1 THEN 1 END) AS review_groups, count(CASE WHEN s = 1 THEN 1 END) AS overlap_groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows_in_groups FROM (SELECT count(*) AS n, count(DISTINCT source) AS s FROM (SELECT {_KEY_S} AS key, source FROM {{documents}}) GROUP BY key HAVING count(*) > 1)""",
      f"""SELECT count(*) AS groups, count(CASE WHEN s > 1 THEN 1 END) AS review_groups, count(CASE WHEN s = 1 THEN 1 END) AS overlap_groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows_in_groups FROM (SELECT count(*) AS n, count(DISTINCT source) AS s FROM (SELECT {_KEY_D} AS key, source FROM documents) GROUP BY key HAVING count(*) > 1)""")
C.sql("a9_coverage", """SELECT d.source, count(*) AS source_blocks, count(l.doc_id) AS covered, count(*) - count(l.doc_id) AS missing, round(count(l.doc_id) / CAST(count(*) AS DOUBLE), 6) AS coverage FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY d.source""")
C.sql("a11_length_stats", """SELECT lang, count(*) AS n, round(avg(n_chars), 4) AS mean, CAST(median(n_chars) AS DOUBLE) AS median, max(n_chars) AS largest, count(CASE WHEN n_chars > 1200 THEN 1 END) AS oversized FROM {documents} GROUP BY lang""")
_VERDICT = "SELECT d.source, CASE WHEN l.toxic = 1 THEN 'rejected' WHEN l.quality = 1 THEN 'correct' ELSE 'partial' END AS verdict FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id"
C.sql("a15_verdict_pivot", f"""SELECT source, count(CASE WHEN verdict = 'correct' THEN 1 END) AS correct, count(CASE WHEN verdict = 'partial' THEN 1 END) AS partial, count(CASE WHEN verdict = 'rejected' THEN 1 END) AS rejected, round(100 * count(CASE WHEN verdict = 'correct' THEN 1 END) / CAST(count(*) AS DOUBLE), 2) AS pct_correct FROM ({_VERDICT}) GROUP BY source""")
C.sql("a15_verdict_rollup", f"""SELECT coalesce(source, '(all)') AS source, coalesce(verdict, '(all)') AS verdict, count(*) AS n FROM ({_VERDICT}) GROUP BY ROLLUP (source, verdict)""")
C.sql("a16_tag_counts", """SELECT dimension, tag, count(DISTINCT doc_id) AS documents, count(*) AS evidence FROM (SELECT doc_id, 'lang' AS dimension, lang AS tag FROM {documents} UNION ALL SELECT doc_id, 'source', source FROM {documents} UNION ALL SELECT doc_id, 'size', CASE WHEN n_chars > 5000 THEN 'long' ELSE 'short' END FROM {documents}) GROUP BY dimension, tag""")
C.sql("a19_shared_text", """SELECT text_hash, count(*) AS n FROM (SELECT sha2(text, 256) AS text_hash, source FROM {documents}) GROUP BY text_hash HAVING count(*) > 1 AND count(*) = count(DISTINCT source)""",
      """SELECT text_hash, count(*) AS n FROM (SELECT sha256(text) AS text_hash, source FROM documents) GROUP BY text_hash HAVING count(*) > 1 AND count(*) = count(DISTINCT source)""")
C.sql("a23_smoke_report", """SELECT count(*) AS total, count(CASE WHEN quality = 1 THEN 1 END) AS passed, count(CASE WHEN quality = 0 THEN 1 END) AS failed FROM {labels}""")
C.sql("a24_distinct_tags", """SELECT lang, array_join(sort_array(collect_set(source)), ',') AS sources FROM {documents} GROUP BY lang""", """SELECT lang, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents GROUP BY lang""")

# Joins
C.sql("j1_alias_priority_join", """WITH keys AS (SELECT lower(replace(s_name, '#', '')) AS k, s_suppkey AS id, 2 AS pr FROM {supplier} UNION ALL SELECT CONCAT('nation', CAST(s_nationkey AS STRING)), s_suppkey, 1 FROM {supplier}),
 best AS (SELECT k, id FROM (SELECT k, id, row_number() OVER (PARTITION BY k ORDER BY pr DESC, id) AS rn FROM keys) WHERE rn = 1)
 SELECT c.c_custkey, coalesce(a.id, b.id) AS supplier_id, CASE WHEN a.id IS NOT NULL THEN 'title' WHEN b.id IS NOT NULL THEN 'file' ELSE 'none' END AS matched FROM {customer} c LEFT JOIN best a ON lower(replace(replace(c.c_name, 'Customer', 'Supplier'), '#', '')) = a.k LEFT JOIN best b ON concat('nation', CAST(c.c_nationkey AS STRING)) = b.k""")
C.sql("j2_unique_fallback_join", """WITH n AS (SELECT n_name, n_nationkey, count(*) OVER (PARTITION BY substring(n_name, 1, 2)) AS same FROM {nation})
 SELECT c.c_custkey, e.n_nationkey AS exact_key, CASE WHEN e.n_nationkey IS NULL THEN 'fallback' ELSE 'exact' END AS how, coalesce(e.same, 0) AS candidates FROM {customer} c LEFT JOIN n e ON c.c_nationkey = e.n_nationkey""")
C.sql("j3_duplicate_key_guard", """SELECT p_brand AS key, count(*) AS n FROM {part} GROUP BY p_brand HAVING count(*) > 1""")
C.sql("j7_full_outer_merge", """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.quality, b.n_chars FROM (SELECT doc_id, quality FROM {labels} WHERE toxic = 1) a FULL OUTER JOIN (SELECT doc_id, n_chars FROM {documents} WHERE n_chars > 3000) b ON a.doc_id = b.doc_id""")
C.sql("j12_composite_fallback", """WITH o AS (SELECT o_custkey, o_orderstatus, min(o_orderkey) AS o_orderkey, count(*) AS n FROM {orders} GROUP BY o_custkey, o_orderstatus), t AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey, count(*) AS n FROM {orders} GROUP BY o_custkey)
 SELECT c.c_custkey, CASE WHEN o.n = 1 THEN o.o_orderkey WHEN o.n IS NULL AND t.n = 1 THEN t.o_orderkey END AS order_key, CASE WHEN o.n = 1 THEN 'both' WHEN o.n IS NULL AND t.n = 1 THEN 'title' WHEN coalesce(o.n, t.n) > 1 THEN 'conflict' ELSE 'none' END AS how FROM {customer} c LEFT JOIN o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'F' LEFT JOIN t ON c.c_custkey = t.o_custkey""")
C.sql("j13_set_gates", """SELECT 'missing' AS gate, d.doc_id AS doc_id FROM {documents} d LEFT ANTI JOIN {labels} l ON d.doc_id = l.doc_id UNION ALL SELECT 'unexpected', l.doc_id FROM {labels} l LEFT ANTI JOIN {documents} d ON d.doc_id = l.doc_id""",
      """SELECT 'missing' AS gate, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'unexpected', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
C.sql("j14_semi", """SELECT d.doc_id, d.source FROM {documents} d LEFT SEMI JOIN (SELECT doc_id FROM {labels} WHERE quality = 1) l ON d.doc_id = l.doc_id""", """SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
C.sql("j15_anti", """SELECT c.c_custkey FROM {customer} c LEFT ANTI JOIN {orders} o ON c.c_custkey = o.o_custkey""", """SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
C.sql("j20_catalogue_join", """SELECT o.o_orderkey, c.c_name, n.n_name, r.r_name, count(l.l_linenumber) AS lines, sum(l.l_quantity) AS quantity FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey WHERE o.o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' GROUP BY o.o_orderkey, c.c_name, n.n_name, r.r_name""")

# Windows
_LINES_S = "SELECT doc_id, CAST(pos AS BIGINT) AS line_no, line FROM {documents} LATERAL VIEW posexplode(split(text, '\\n')) x AS pos, line"
_LINES_D = "SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::BIGINT AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents"


def _lines(name: str, sql: str, duck: str | None = None) -> None:
    C.sql(name, f"WITH b AS ({_LINES_S}) {sql}", f"WITH b AS ({_LINES_D}) {duck or sql}")


_lines("w3_dup_suffix", """SELECT doc_id, line_no, concat(base, CASE WHEN rn > 1 THEN concat('_', CAST(rn AS STRING)) ELSE '' END) AS id FROM (SELECT doc_id, line_no, substring(line, 1, 3) AS base, row_number() OVER (PARTITION BY doc_id, substring(line, 1, 3) ORDER BY line_no) AS rn FROM b)""")
C.sql("w4_monotonic", """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {orders}) WHERE m IS NULL OR o_totalprice >= m""")
_lines("w5_section_path", """SELECT doc_id, line_no, max(CASE WHEN length(line) <= 30 THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section_line FROM b""")
C.sql("w6_contiguity", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, rn FROM (SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS BIGINT) AS rn FROM {lineitem} WHERE l_returnflag <> 'R') WHERE rn <> l_linenumber""")
_lines("w7_neighbour", """SELECT doc_id, line_no, n AS next_length FROM (SELECT doc_id, line_no, line, CAST(lead(length(line)) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS n FROM b) WHERE line LIKE '%,' OR n < 10""")
C.sql("w8_order_regression", """SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, o_orderdate, scope, lag(o_orderdate) OVER (PARTITION BY o_custkey, scope ORDER BY o_orderkey) AS p FROM (SELECT *, sum(CASE WHEN ch THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS scope FROM (SELECT *, coalesce(lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <> o_orderstatus, false) AS ch FROM {orders}))) WHERE o_orderdate < p""")
C.sql("w9_gaps", """WITH x AS (SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM {orders}),
 r AS (SELECT *, sum(CASE WHEN o_orderkey < p THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY rn) AS run FROM x)
 SELECT o_custkey, CAST(run AS BIGINT) AS run, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, count(CASE WHEN o_orderkey > p + 1000 THEN 1 END) AS gaps FROM r GROUP BY o_custkey, run""")
_lines("w10_offsets", """SELECT doc_id, line_no, CAST(coalesce(sum(length(line) + CASE WHEN trim(line) = '' THEN 0 ELSE 2 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char FROM b""")
_lines("w11_sticky_flag", """SELECT doc_id, line_no, max(CASE WHEN length(line) < 20 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS after_heading FROM b""")
C.sql("w16_latest_n", """SELECT conv_id, turn, rn FROM (SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS BIGINT) AS rn FROM {conversations}) WHERE rn <= 3""")
C.sql("w17_prev_user", """SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS user_turn FROM {conversations}""")
_lines("w18_caption", """SELECT doc_id, line_no, md5(CASE WHEN length(p) <= 100 THEN p ELSE '' END) AS caption FROM (SELECT doc_id, line_no, line, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS p FROM b) WHERE line LIKE '%|%' AND p IS NOT NULL""")
_lines("w19_first_match", """SELECT doc_id, min(line_no) AS line_no FROM b WHERE line LIKE '%License%' OR line LIKE '%licensed%' OR line LIKE '%rights reserved%' GROUP BY doc_id""")

# Sorts and caps
C.sql("t6_top_cap", """SELECT * FROM (SELECT source, doc_id, n_chars, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) AS BIGINT) AS rn FROM {documents}) WHERE rn <= 5""")
C.sql("t7_priority_sort", """SELECT doc_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY CASE source WHEN 'src3' THEN 0 WHEN 'src1' THEN 1 ELSE 2 END, CASE WHEN source IN ('src3', 'src1') THEN substring(text, 1, 20) ELSE '' END, doc_id) AS BIGINT) AS position FROM {documents}""")
C.sql("t8_missing_last", """SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(CASE WHEN o_orderpriority LIKE '1%' THEN 1 WHEN o_orderpriority LIKE '2%' THEN 2 END, 9999), o_orderkey) AS BIGINT) AS position FROM {orders}""")

# Sets
C.sql("u4_array_except", """SELECT source, CAST(size(array_except(a, b)) AS BIGINT) AS missing, CAST(size(array_intersect(a, b)) AS BIGINT) AS shared FROM (SELECT source, collect_set(d.doc_id) AS a, collect_set(l.doc_id) AS b FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY source)""",
      """SELECT source, count(*) - count(l.doc_id) AS missing, count(l.doc_id) AS shared FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source""")
C.sql("u5_exact_set", """SELECT (SELECT count(*) FROM (SELECT doc_id FROM {documents} EXCEPT SELECT doc_id FROM {labels})) AS only_left, (SELECT count(*) FROM (SELECT doc_id FROM {labels} EXCEPT SELECT doc_id FROM {documents})) AS only_right, (SELECT count(*) FROM {labels}) AS right_rows""")
C.sql("u8_delete_reindex", """SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS row_index FROM {documents} WHERE NOT (lang = 'de' AND n_chars < 500)""")
C.sql("u9_upsert", """SELECT d.doc_id, coalesce(l.quality, -1) AS quality, CASE WHEN l.doc_id IS NULL THEN 'kept' ELSE 'updated' END AS status FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""")

# Events: the reference has no event-time windows; these are extensions
C.sql("ext_tumbling", """SELECT window.start AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM {events} GROUP BY window(ts, '1 hour'), event_type""", """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
C.sql("ext_sliding", """SELECT window.start AS start, count(*) AS n FROM {events} GROUP BY window(ts, '2 hours', '1 hour')""", """SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY start""")
C.sql("x2_session_window", """SELECT user_id, session_window.start AS start, count(*) AS n FROM {events} GROUP BY user_id, session_window(ts, '2 hours')""",
      """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(CASE WHEN ts > p + INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY user_id, s""")
C.sql("x6_event_order", """SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq, get_json_object(props, '$.k') AS k FROM {events}""",
      """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, json_extract_string(props, '$.k') AS k FROM events""")
C.sql("ext_watermark_dedup", """SELECT user_id, event_type, min(event_id) AS event_id, count(*) AS n FROM {events} GROUP BY user_id, event_type""")

# Incremental builds: documents against a version in which some texts have changed
_OLD = "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN md5(concat(text, '!')) ELSE md5(text) END AS hash, 'v1' AS version FROM {documents} WHERE doc_id % 7 <> 0"
C.sql("x10_incremental_plan", f"""SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'stale' WHEN n.hash = o.hash AND n.version = o.version THEN 'reused' ELSE 'changed' END AS status FROM (SELECT doc_id, md5(text) AS hash, 'v1' AS version FROM {{documents}} WHERE doc_id % 11 <> 0) n FULL OUTER JOIN ({_OLD}) o ON n.doc_id = o.doc_id""")
C.sql("j17_vector_reuse", f"""SELECT CASE WHEN o.doc_id IS NULL THEN 'new_embedded' WHEN o.hash = n.hash THEN 'reused' ELSE 'changed_reembedded' END AS status, count(*) AS n FROM (SELECT doc_id, md5(text) AS hash FROM {{documents}}) n LEFT JOIN ({_OLD}) o ON n.doc_id = o.doc_id GROUP BY 1""")
