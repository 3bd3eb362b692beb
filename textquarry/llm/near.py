"""SimHash near-dedup at a stated similarity of shingle sets: a self-join of binary tries finds the pairs, sets decide.

A text's set is that of its shingles of ``SHINGLE`` words (all its words, where it has fewer). Equal texts are one node
first. The method is that of ``simhash``, on fingerprints of five words: its links (``BITS`` bits, buckets of equal blocks)
are candidates. Texts at the similarity asked for differ in about 10 of 64 bits, with a deviation of 3, which blocks of equal
bits can't bring together; so the fingerprints are dealt into further buckets, and the same binary-trie self-join runs in
each with an error budget of ``WRONG`` bits. These buckets are the bands of ``BANDS`` x ``ROWS`` minima of a node's hashed
shingles; two nodes of similarity s share one with probability 1 - (1 - s**ROWS)**BANDS: 0.998 at 0.8, nearly 1 at 0.9.
Candidates whose sets' sizes allow the similarity are compared on their words, and only pairs that reach ``LEAST`` are linked.

In a first round the self-join gives each node of a bucket ``PARTNERS`` candidates, neighbours in the trie's order first. What
they link is one component, within which no further link changes anything. Buckets that had more candidates are joined again
with four times as many, between components alone, until each has given all: no pair that meets in a bucket is left out.

Defined results: a null id is an id; other columns are left out, whatever their names; a text of any length is read whole;
null text has no words; texts without words are one group; a text's words are lower case (A-Z), split at ASCII white space; an
empty table gives none.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored
from .components import components
from .simhash import BITS, links, trie_links, whole_buckets

SHINGLE, LEAST, BANDS, ROWS, PARTNERS, SEED, WRONG = 5, 0.8, 20, 6, 8, 42, 26
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_FACTORS = np.random.default_rng(SEED).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, size: int = SHINGLE) -> set[bytes]:
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    return {b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def hashes(found: set[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(x, SEED) for x in found), np.uint64, len(found))


def simhash(h: np.ndarray) -> int:
    """Signed; a bit is 1 if over half of the hashes have it."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        counts += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(h), bitorder="little").tobytes(), "little", signed=True)


def bands(h: np.ndarray) -> np.ndarray:
    """A hash of each band's minima."""
    from xxhash import xxh64_intdigest

    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 256):
        part = h[at : at + 256, None] * _FACTORS
        np.minimum(least, (part ^ (part >> np.uint64(32))).min(0), out=least)
    return np.array([xxh64_intdigest(row.tobytes(), SEED) for row in least.reshape(BANDS, ROWS)], np.uint64).view(np.int64)


def _node(text: Column) -> Column:
    """A hash of the text; one for all texts without words."""
    blank = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r\x0b\f")) == ""
    return F.when(blank, F.lit(0).cast("long")).otherwise(F.xxhash64(text))


def _signed(texts: DataFrame) -> DataFrame:
    """(node, n, fp, bands): n is the size of the set, fp its SimHash; no row for a set without shingles."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, prints, found = [], [], [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if own := shingles(text.as_py()):
                    nodes.append(node)
                    sizes.append(len(own))
                    h = hashes(own)
                    prints.append(simhash(h))
                    found.append(bands(h))
            columns = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "n", "fp", "bands"])

    return texts.mapInArrow(each, "node long, n long, fp long, bands array<long>")


def _similar(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets reach ``least``. texts (node, text): one row a node."""
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"{c}_text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, set()
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column("a").to_pylist(), batch.column("a_text"), batch.column("b_text"), strict=True):
                if a != last:
                    last, own = a, shingles(x.as_py())
                keep.append(jaccard(own, shingles(y.as_py())) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(side("b"), "b").join(side("a"), "a")
    return met.select("a", "b", "a_text", "b_text").mapInArrow(each, "a long, b long")


class Candidates:
    """Takes the links of ``trie_links`` between places of different roots whose sizes fit, up to ``most`` for a place."""

    def __init__(self, sizes: np.ndarray, roots: np.ndarray, least: float, most: int):
        self.sizes, self.roots, self.least, self.most = sizes, roots, least, most
        self.given, self.links = np.zeros(len(sizes), np.int64), []
        self.cut = False  # whether one was left out

    def current(self) -> np.ndarray:
        return self.roots

    def closed(self) -> np.ndarray:
        """Places that have all they may have; what else is near to them isn't known."""
        full = self.given >= self.most
        self.cut |= bool(full.any())
        return full

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        x, y = self.sizes[a], self.sizes[b]
        keep = (self.roots[a] != self.roots[b]) & (np.minimum(x, y) >= self.least * np.maximum(x, y) - 1e-9)
        a, b = a[keep], b[keep]
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a, "left")
        keep = self.given[a] + rank < self.most
        self.cut |= not keep.all()
        a, b = a[keep], b[keep]
        self.given += np.bincount(a, minlength=len(self.given))
        self.links.append((a, b))


def _joined(buckets: DataFrame, least: float, most: int) -> DataFrame:
    """(a, b, bucket) of the candidates in each bucket, and one row without a and b for a bucket that has more of them.

    buckets: bucket, node, n, fp and root, a number that the nodes of a component share.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, node, n, fp, root in whole_buckets(batches):
            fp = fp.view(np.uint64)
            starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            size = np.diff(np.append(starts, len(bucket)))
            # The trie of two is a pair; those of all buckets at once.
            x = starts[size == 2]
            y = x + 1
            fits = (root[x] != root[y]) & (np.minimum(n[x], n[y]) >= least * np.maximum(n[x], n[y]) - 1e-9)
            fits &= np.bitwise_count(fp[x] ^ fp[y]) <= WRONG
            a, b, more = [x[fits]], [y[fits]], []
            for s, m in zip(starts[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                at = s + np.argsort(fp[s : s + m], kind="stable")
                found = Candidates(n[at], root[at], least, most)
                for x, y in trie_links(fp[at], WRONG, into=found):
                    a.append(at[x])
                    b.append(at[y])
                if found.cut:
                    more.append(s)
            a, b = np.concatenate(a), np.concatenate(b)
            none = pa.nulls(len(more), pa.int64())
            low, high = np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
            columns = [pa.concat_arrays([pa.array(v), none]) for v in (low, high)] + [pa.array(bucket[np.concatenate((a, np.array(more, np.int64)))])]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "bucket"])

    dealt = buckets.select("bucket", "node", "n", "fp", "root").repartition(F.col("bucket")).sortWithinPartitions("bucket")
    return dealt.mapInArrow(each, "a long, b long, bucket long")


def near_groups(docs: DataFrame, id_col: str, text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(id, component_id) of every distinct id and text: rows of equal texts or linked words share a component_id."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), _node(F.col(text_col)).alias("node"), F.col(text_col).alias("text"))
    nodes = stored(_signed(rows.select("node", "text")).dropDuplicates(["node"]))
    # The links of fingerprints, by a node for each; nodes of one fingerprint are linked to it.
    reps = stored(nodes.groupBy("fp").agg(F.min("node").alias("rep")))
    side = lambda c: reps.select(F.col("fp").alias(c), F.col("rep").alias(f"{c}_rep"))
    near = links(reps.select("fp"), BITS).distinct().join(side("a"), "a").join(side("b"), "b").select("a_rep", "b_rep")
    near = near.unionByName(nodes.join(reps, "fp").where("rep < node").select(F.col("rep").alias("a_rep"), F.col("node").alias("b_rep")))
    pairs = near.select(F.least("a_rep", "b_rep").alias("a"), F.greatest("a_rep", "b_rep").alias("b"))

    dealt = nodes.select("node", "n", "fp", F.posexplode("bands").alias("k", "band")).select(F.xxhash64("k", "band").alias("bucket"), "node", "n", "fp")
    most, edges, met = PARTNERS, None, None
    buckets = dealt.withColumn("root", F.col("node"))
    while True:
        made = stored(_joined(buckets, least, most))
        new = made.where("a is not null").select("a", "b")
        pairs = stored(new.unionByName(pairs).distinct() if met is None else new.distinct().join(met, ["a", "b"], "left_anti"))
        met = pairs if met is None else met.unionByName(pairs)
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        texts = stored(rows.select("node", "text").join(ends, "node", "left_semi").dropDuplicates(["node"]))
        found = stored(_similar(pairs, texts, least))
        edges = found if edges is None else edges.unionByName(found)
        labels = components(edges)
        more = made.where("a is null").select("bucket").distinct()
        if more.isEmpty():
            break
        left = dealt.join(more, "bucket", "left_semi").join(labels, "node", "left")
        left = stored(left.select("bucket", "node", "n", "fp", F.coalesce("component", "node").alias("root")))
        apart = left.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
        buckets, most = left.join(apart, "bucket", "left_semi"), 4 * most
    of = rows.select(F.col(id_col), "node").distinct()
    return of.join(labels, "node", "left").select(id_col, F.coalesce("component", "node").alias("component_id"))
