"""SimHash near-dedup: 64-bit fingerprints and a self-join of binary tries.

Distinct fingerprints go into buckets first: cut into ``BLOCKS`` blocks, two fingerprints with at most ``bits`` differing
bits agree in at least BLOCKS - bits of them, so one of the C(BLOCKS, BLOCKS - bits) choices of equal blocks brings them
together (6 blocks, 4 bits: 15 buckets of about 21 bits each). A bucket of more than ``SPLIT`` fingerprints is dealt once more
in the same way by blocks of its other bits, which makes 15 of about 35 bits, so a crowded bucket isn't one task's work. A
bucket is a binary trie over the fingerprints in order.
Pairs of its nodes are traversed together, level by level; the differing bits of the prefixes add up, and a pair beyond
the error budget is pruned. So is a pair whose two subtrees lie wholly in one component already: what is asked for are
components, and within one no further link changes them. Before the traversal, neighbours in the order of the trie, and
in that of the rotated fingerprints, are linked where they are near, which makes dense groups such subtrees early. A bucket
thus yields a spanning forest of its links, never all pairs. Node pairs of at most ``LEAF`` fingerprint pairs are compared
directly, the others go depth-first, at most ``FRONTIER`` at a time, so memory is that of the bucket's levels. The forests are
joined by ``components``.

Defined results: null text has no words; texts without words have fingerprint zero and are linked like others; equal
fingerprints are one node, represented by their smallest doc_id; null doc_ids take no part in that minimum, and a
group of only null doc_ids has a null component; repeated rows come out as often as they are; a text of any length is hashed
whole, 4,096 shingles at a time; other columns are left out, whatever their names; an empty table gives none.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored, table
from .components import components

SHINGLE, BITS, BLOCKS, SEED = 4, 4, 6, 42
SPLIT, LEAF, FRONTIER = 16_384, 256, 1 << 20
# Lower-cased A-Z; words are [^\x20\x09-\x0D]+.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SCHEMA = "doc_id long, fp long"


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Unsigned: a bit is 1 if over half of the shingles' XXH64 have it."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    if n == 1:
        return xxh64_intdigest(b" ".join(words[:size] if len(words) >= size else words), SEED)
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[size - 1 :] - 1).tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        h = np.array([xxh64_intdigest(flat[a:b], SEED) for a, b in zip(starts[at : at + 4096], stops[at : at + 4096], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), size) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(each, SCHEMA)


class _Forest:
    """Union-find over places, with the links that joined two trees."""

    def __init__(self, m: int):
        self.parent, self.links = list(range(m)), []
        self.roots, self.fresh = np.arange(m), True

    def _root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            u, v = self._root(x), self._root(y)
            if u != v:
                self.parent[max(u, v)] = min(u, v)
                self.links.append((x, y))
                self.fresh = False

    def current(self) -> np.ndarray:
        """The root of each place."""
        if not self.fresh:
            roots = np.array(self.parent)
            while (roots != (up := roots[roots])).any():
                roots = up
            self.roots, self.fresh = roots, True
        return self.roots


def trie_links(points: np.ndarray, bits: int = BITS, leaf: int = LEAF, frontier: int = FRONTIER, into=None) -> list[tuple[int, int]]:
    """Spanning forest, as places, of the links of uint64 fingerprints in ascending order.

    ``leaf`` and ``frontier`` decide how the work is cut, not which fingerprints are linked in the end. ``into`` takes the
    links in place of a forest: by ``link``, with the roots ``current`` to it, and ``closed`` places that need no more.
    """
    m = len(points)
    if m == 2 and into is None:
        return [(0, 1)] if int(points[0] ^ points[1]).bit_count() <= bits else []
    forest = _Forest(m) if into is None else into

    def direct(a0: np.ndarray, b0: np.ndarray, na: np.ndarray, nb: np.ndarray) -> None:
        """Compares all members of the ranges from a0 and b0."""
        size = na * nb
        for part in np.split(np.arange(len(size)), np.flatnonzero(np.diff(np.cumsum(size) // frontier)) + 1):
            s = size[part]
            k = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
            width = np.repeat(nb[part], s)
            x, y = np.repeat(a0[part], s) + k // width, np.repeat(b0[part], s) + k % width
            roots = forest.current()
            keep = (x < y) & (roots[x] != roots[y])
            x, y = x[keep], y[keep]
            near = np.bitwise_count(points[x] ^ points[y]) <= bits
            forest.link(x[near], y[near])

    one = np.zeros(1, np.int64)
    if m * m <= leaf:
        direct(one, one, one + m, one + m)
        return forest.links
    for turn in range(0, 64, 8):
        turned = (points << np.uint64(turn)) | (points >> np.uint64(64 - turn)) if turn else points
        order = np.argsort(turned, kind="stable")
        near = np.bitwise_count(points[order[1:]] ^ points[order[:-1]]) <= bits
        forest.link(order[:-1][near], order[1:][near])
    # The nodes of a depth are ranges of places with a common prefix, by their first place.
    starts = [np.flatnonzero(np.concatenate(([True], (points[1:] ^ points[:-1]) >> np.uint64(64 - d) != 0))) if d else np.zeros(1, np.int64) for d in range(65)]

    def children(d: int) -> np.ndarray:
        below = starts[d + 1]
        out = np.full((len(starts[d]), 2), -1)
        out[np.searchsorted(starts[d], below, "right") - 1, ((points[below] >> np.uint64(63 - d)) & np.uint64(1)).astype(np.int64)] = np.arange(len(below))
        return out

    todo = [(0, one, one, one)]  # depth, nodes of both sides, differing bits
    while todo:
        d, left, right, wrong = todo.pop()
        if len(left) > frontier:
            half = len(left) // 2
            todo += [(d, left[:half], right[:half], wrong[:half]), (d, left[half:], right[half:], wrong[half:])]
            continue
        child = children(d)
        parts = []
        for x in (0, 1):
            for y in (0, 1):
                a, b = child[left, x], child[right, y]
                w = wrong + (x != y)
                keep = (a >= 0) & (b >= 0) & (w <= bits)
                if x > y:
                    keep &= left != right  # else it is the pair of y and x
                parts.append((a[keep], b[keep], w[keep]))
        left, right, wrong = (np.concatenate([p[k] for p in parts]) for k in range(3))
        d += 1
        first, roots = starts[d], forest.current()
        low, high = np.minimum.reduceat(roots, first), np.maximum.reduceat(roots, first)
        open_ = ~((low[left] == high[left]) & (low[right] == high[right]) & (low[left] == low[right]))
        if into is not None:
            open_ &= ~np.logical_and.reduceat(into.closed(), first)[left]
        left, right, wrong = left[open_], right[open_], wrong[open_]
        count = np.diff(np.append(first, m))
        small = (count[left] * count[right] <= leaf) | (d == 64)
        if small.any():
            direct(first[left[small]], first[right[small]], count[left[small]], count[right[small]])
        if not small.all():
            todo.append((d, left[~small], right[~small], wrong[~small]))
    return forest.links


def _masks(bits: int, blocks: int, of: int = (1 << 64) - 1) -> list[int]:
    """For each choice of blocks that stay equal, the mask of their bits; ``of`` are the bits that are cut into blocks."""
    places = [k for k in range(64) if of >> k & 1]
    borders = [len(places) * k // blocks for k in range(blocks + 1)]
    cut = [sum(1 << p for p in places[a:b]) for a, b in zip(borders[:-1], borders[1:], strict=True)]
    return [sum(c) for c in combinations(cut, blocks - bits)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _dealt(points: DataFrame, bits: int, blocks: int, split: int) -> DataFrame:
    """(bucket, fp): fingerprints within ``bits`` of each other share a bucket."""
    masks = _masks(bits, blocks)
    keys = F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for k, m in enumerate(masks)))
    dealt = points.select("fp", F.explode(keys).alias("key")).select(F.xxhash64("key.k", "key.part").alias("bucket"), "fp", "key.k")
    large = stored(dealt.groupBy("bucket").count().where(F.col("count") > split).select("bucket"))
    if large.isEmpty():
        return dealt.select("bucket", "fp")
    # Members of a bucket agree in its mask, so what they may differ in lies outside it.
    finer = F.array(*(F.array(*(F.lit(_signed(x)) for x in _masks(bits, blocks, ~m & (1 << 64) - 1))) for m in masks))
    crowded = dealt.join(large, "bucket", "left_semi").select("bucket", "fp", F.posexplode(F.element_at(finer, F.col("k") + 1)).alias("j", "mask"))
    crowded = crowded.select(F.xxhash64("bucket", "j", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"), "fp")
    return dealt.join(large, "bucket", "left_anti").select("bucket", "fp").unionByName(crowded)


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of rows in the order of the first one, cut where its value changes."""
    rest: list[list[np.ndarray]] = []  # the last bucket so far
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        if not batch.num_rows:
            continue
        if rest and rest[0][0][0] == columns[0][-1]:  # all of it goes on with the bucket at hand
            rest.append(columns)
            continue
        last = int(np.searchsorted(columns[0], columns[0][-1], "left"))
        yield [np.concatenate(c) for c in zip(*rest, [c[:last] for c in columns], strict=True)]
        rest = [[c[last:] for c in columns]]
    if rest:
        yield [np.concatenate(c) for c in zip(*rest, strict=True)]


def links(points: DataFrame, bits: int = BITS, blocks: int = BLOCKS, split: int = SPLIT) -> DataFrame:
    """Edges (a, b) between fingerprints that connect all that are within ``bits`` of each other. points: distinct fp, stored."""
    dealt = _dealt(points, bits, blocks, split)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, fp in whole_buckets(batches):
            a, b = [], []
            starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            ends = np.append(starts[1:], len(bucket))
            for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                members = np.sort(fp[s:e].view(np.uint64))
                for x, y in trie_links(members, bits):
                    a.append(members[x])
                    b.append(members[y])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(v, np.uint64).view(np.int64)) for v in (a, b)], ["a", "b"])

    # Sorted by bucket, so a task holds one bucket and one batch at a time.
    return dealt.repartition(F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(joined, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, bits: int = BITS, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    prints = stored(fingerprints(docs, id_col, text_col, size))
    reps = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    edges = stored(links(reps.select("fp"), bits, blocks).distinct())
    # Components over fingerprints, then the smallest doc_id of each.
    found = components(edges).withColumnRenamed("node", "fp")
    least = found.join(reps, "fp").groupBy("component").agg(F.min("rep").alias("least"))
    of = stored(reps.join(found.join(least, "component").select("fp", "least"), "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id")))
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
