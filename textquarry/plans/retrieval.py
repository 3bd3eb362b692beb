"""Retrieval queries."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textquarry.functions import text as T
from textquarry.operators import retrieval as R
from textquarry.operators import notes

from .base import Catalogue, Tables

C = Catalogue()

TOKENS = r"""
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:[._/-][a-z0-9]+)*')) AS term FROM benchmark),
tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+(?:[._/-][a-z0-9]+)*') AS t FROM documents),
dl AS (SELECT doc_id, len(t) AS dl FROM tok),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
post AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
scored AS (
  SELECT q.query_id, p.doc_id,
    round(sum(ln((s.n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE) + 1) * (p.tf * 2.5::DOUBLE) / (p.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl.dl / greatest(s.avgdl, 1.0::DOUBLE)))), 6) AS bm25
  FROM post p JOIN q USING (term) JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN stats s GROUP BY ALL),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id) AS rank FROM scored WHERE bm25 > 0) WHERE rank <= 30)"""
VECTORS = r"""
cosq AS (SELECT item_id AS query_id, e.embedding AS qv FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
cosh AS (SELECT c.query_id, e.vec_id AS doc_id, round(list_dot_product(c.qv::DOUBLE[], e.embedding::DOUBLE[]), 6) AS vector FROM cosq c CROSS JOIN embeddings e),
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vector DESC, doc_id) AS rank FROM cosh WHERE vector > 0) WHERE rank <= 30)"""
FUSED = r"""
both_ AS (SELECT coalesce(b.query_id, v.query_id) AS query_id, coalesce(b.doc_id, v.doc_id) AS doc_id, b.rank AS bm25_rank, v.rank AS vector_rank, b.bm25 AS bm25_score, v.vector AS vector_score,
  round(coalesce(1.0::DOUBLE / (60 + b.rank), 0) + coalesce(1.0::DOUBLE / (60 + v.rank), 0), 6) AS rrf
  FROM bm b FULL JOIN vec v ON b.query_id = v.query_id AND b.doc_id = v.doc_id),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, bm25_rank ASC NULLS LAST, doc_id) AS rank FROM both_) WHERE rank <= 60)"""
CAPPED = r"""
capped AS (SELECT f.*, d.source, row_number() OVER (PARTITION BY query_id, d.source ORDER BY f.rank) AS group_rank FROM fused f JOIN documents d USING (doc_id)),
top AS (SELECT query_id, doc_id, source, rrf, bm25_rank, vector_rank, rank AS fused_rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM capped WHERE group_rank <= 3 QUALIFY rank <= 1000000),
top10 AS (SELECT * FROM top WHERE rank <= 10)"""
TOP = CAPPED.replace(" QUALIFY rank <= 1000000", "")


def _bm25(t: Tables):
    return R.bm25_search(t.benchmark, t.documents)


def _vector(t: Tables):
    seeds = t.benchmark.join(t.embeddings, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), "embedding")
    return R.cosine_search(seeds, t.embeddings).select("query_id", F.col("id").alias("doc_id"), "vector", "rank")


def _fused(t: Tables, bm25=None):
    return R.reciprocal_rank_fusion(_bm25(t) if bm25 is None else bm25, _vector(t))


def _capped(t: Tables, bm25=None):
    return R.diversify(_fused(t, bm25).join(t.documents.select("doc_id", "source"), "doc_id"), "source")


@C.add(f"WITH {TOKENS} SELECT query_id, doc_id, bm25, rank FROM bm")
def r2_bm25_topk(t: Tables):
    return _bm25(t)


@C.add("WITH h AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS vector FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 100 = 0) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vector DESC, id) AS rank FROM h WHERE vector > 0) WHERE rank <= 30")
def r3_cosine_topk(t: Tables):
    """The stated query set: every vector whose id is divisible by 100, against all vectors."""
    queries = t.embeddings.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return R.cosine_search(queries, t.embeddings)


@C.add(f"WITH {TOKENS}, {VECTORS}, {FUSED} SELECT query_id, doc_id, bm25_rank, vector_rank, bm25_score, vector_score, rrf, rank FROM fused")
def r4_rrf(t: Tables):
    return _fused(t)


FLAGSHIP = f"WITH {TOKENS}, {VECTORS}, {FUSED}, {TOP} SELECT query_id, rank, doc_id, source, rrf, bm25_rank, vector_rank FROM top10"


@C.add(FLAGSHIP)
def r5_cap_per_document(t: Tables):
    return _capped(t).select("query_id", "rank", "doc_id", "source", "rrf", "bm25_rank", "vector_rank")


@C.add(FLAGSHIP)
def flagship(t: Tables):
    return r5_cap_per_document(t)


@C.add(f"""WITH {TOKENS}, {VECTORS}, {FUSED}, {TOP} SELECT query_id, doc_id, rank, text_hash FROM (
  SELECT t.query_id, t.doc_id, t.rank, sha256(regexp_replace(d.text, '\\s+', '', 'g')) AS text_hash, row_number() OVER (PARTITION BY t.query_id, sha256(regexp_replace(d.text, '\\s+', '', 'g')) ORDER BY t.rank) AS k
  FROM top10 t JOIN documents d USING (doc_id)) WHERE k = 1""")
def r6_evidence_dedup(t: Tables):
    """Hits whose whitespace-free text a better hit of the query has go."""
    # Ten rows a query go to the documents, whose texts stay where they are read; only the hits' are hashed.
    hits = t.documents.select("doc_id", "text").join(F.broadcast(_capped(t)), "doc_id").withColumn("text_hash", F.sha2(T.compact("text"), 256))
    first = F.row_number().over(Window.partitionBy("query_id", "text_hash").orderBy("rank"))
    return hits.withColumn("k", first).where("k = 1").select("query_id", "doc_id", "rank", "text_hash")


@C.add()
def r6_evidence(t: Tables):
    """Full evidence assembly; documents of a source are its chunks, in doc_id order."""
    corpus = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.col("doc_id").alias("chunk_index"), "text", F.lit(None).cast("long").alias("overlap_source_chunk_id"))
    return R.assemble_evidence(_capped(t).select("query_id", F.col("doc_id").alias("chunk_id"), "rank"), corpus)


@C.add()
def r12_multi_query_merge(t: Tables):
    """Two ranked lists a query (whole item, its first line), interleaved by turns."""
    short = t.benchmark.select("item_id", T.latin_lead("text").alias("text"))
    both = t.benchmark.select((F.col("item_id") * 2).alias("item_id"), "text").unionByName(short.select((F.col("item_id") * 2 + 1).alias("item_id"), "text"))
    lists = R.bm25_search(both, t.documents).select(F.expr("query_id div 2").alias("query_id"), F.pmod("query_id", F.lit(2)).cast("int").alias("list_no"), "rank", "doc_id")
    return R.interleave(lists)


@C.add(f"WITH {TOKENS}, {VECTORS}, {FUSED} SELECT query_id, doc_id, rank, round(least(1.0, rrf / greatest(max(rrf) OVER (PARTITION BY query_id), 1.0::DOUBLE / 61)), 6) AS score FROM fused")
def r14_score_norm(t: Tables):
    return R.normalised_score(_fused(t)).select("query_id", "doc_id", "rank", "score")


@C.add(f"""WITH {TOKENS}, {VECTORS}, {FUSED}, {TOP},
 u AS (SELECT query_id, doc_id, 0 AS src, rank FROM top10 UNION ALL SELECT query_id, doc_id, 1, rank FROM bm WHERE rank <= 10),
 f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY src, rank) AS k FROM u) WHERE k = 1),
 s AS (SELECT f.*, d.source, row_number() OVER (PARTITION BY query_id, d.source ORDER BY src, f.rank) AS g FROM f JOIN documents d USING (doc_id)),
 o AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY src, rank) AS position FROM s WHERE g <= 3)
 SELECT * FROM o WHERE position <= 10""")
def r15_two_round_merge(t: Tables):
    """Retained hits before the new round's, first occurrences only, then the caps."""
    bm25 = _bm25(t)
    u = _capped(t, bm25).select("query_id", "doc_id", F.lit(0).alias("src"), "rank").unionByName(bm25.where("rank <= 10").select("query_id", "doc_id", F.lit(1).alias("src"), "rank"))
    firsts = R.ranked(u, ["query_id", "doc_id"], [F.col("src"), F.col("rank")], 1, "k").join(t.documents.select("doc_id", "source"), "doc_id")
    kept = R.ranked(firsts, ["query_id", "source"], [F.col("src"), F.col("rank")], 3, "g")
    return R.ranked(kept, ["query_id"], [F.col("src"), F.col("rank")], 10, "position").select("query_id", "doc_id", "position")


NOTES = r"""
n AS (SELECT conv_id * 100 + turn AS note_id, text, list_distinct(regexp_extract_all(lower(regexp_extract(text, '^([^\n]*)', 1)), '[a-z0-9.%]+')) AS title_t, list_distinct(regexp_extract_all(lower(text), '[a-z0-9.%]+')) AS body_t FROM conversations WHERE role = 'assistant'),
q AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9.%]+')) AS t FROM benchmark),
s AS (SELECT query_id, note_id, round((3 * len(list_intersect(q.t, title_t)) + len(list_intersect(q.t, body_t))) / sqrt(greatest(len(q.t), 1)::DOUBLE), 6) AS score FROM q CROSS JOIN n)"""


@C.add(f"WITH {NOTES} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, note_id DESC) AS rank FROM s WHERE score > 0) WHERE rank <= 4")
def r16_wiki_search(t: Tables):
    store = t.conversations.where("role = 'assistant'").select((F.col("conv_id") * 100 + F.col("turn")).alias("note_id"), T.latin_lead("text").alias("title"), F.col("text").alias("content"), (F.col("conv_id") * 100 + F.col("turn")).alias("updated_at"))
    return notes.search(t.benchmark.select(F.col("item_id").alias("query_id"), "text"), store)


@C.add(r"""WITH c AS (SELECT conv_id, conv_id * 100 + turn AS note_id, sha256(lower(regexp_replace(text, '\s+', '', 'g'))) AS key FROM conversations),
 old AS (SELECT key, min(note_id) AS note_id FROM c WHERE conv_id % 2 = 0 GROUP BY key),
 new AS (SELECT key, min(note_id) AS note_id FROM c WHERE conv_id % 2 = 1 AND key NOT IN (SELECT key FROM old) GROUP BY key)
 SELECT note_id, key, 'kept' AS status FROM old UNION ALL SELECT note_id, key, 'added' FROM new""")
def r17_wiki_upsert(t: Tables):
    """Notes of odd conversations go to a store of the even ones' unless their normalised content is there."""
    n = t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("note_id"), "conv_id", F.col("text").alias("content"))
    store = notes.first_of_each(n.where("conv_id % 2 = 0"))
    return notes.upsert(store, n.where("conv_id % 2 = 1")).select("note_id", "key", "status")


@C.add("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) * (x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))))), 4) AS norm FROM embeddings")
def r10_l2_normalise(t: Tables):
    v = F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x)
    return t.embeddings.select("vec_id", R.unit(F.col("embedding")).alias("u")).select("vec_id", F.round(v, 4).alias("norm"))


@C.add("WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT label::BIGINT AS label, pos::BIGINT AS pos, round(avg(x), 6) AS mean FROM e GROUP BY ALL")
def a20_mean_pool(t: Tables):
    e = t.embeddings.select("label", F.posexplode("embedding").alias("pos", "x"))
    return e.groupBy(F.col("label").cast("long").alias("label"), F.col("pos").cast("long").alias("pos")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@C.add("WITH s AS (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 40, 1), 380)) AS start FROM documents) SELECT doc_id, start, sha256(text[start + 1 : start + 420]) AS segment_sha256 FROM s")
def r7_segments(t: Tables):
    each = F.transform(R.embedding_segments(F.col("text")), lambda s, k: F.struct((k * 380).cast("long").alias("start"), F.sha2(s, 256).alias("segment_sha256")))
    return t.documents.select("doc_id", F.inline(each))


@C.add("SELECT source, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS fingerprint FROM documents GROUP BY source")
def r8_fingerprint(t: Tables):
    """Order-aware fingerprint of a group's inputs; each text is hashed before it is gathered."""
    hashed = F.struct("doc_id", F.sha2("text", 256).alias("h"))
    return t.documents.groupBy("source").agg(F.sort_array(F.collect_list(hashed)).alias("x")).select("source", F.sha2(F.array_join("x.h", ""), 256).alias("fingerprint"))
