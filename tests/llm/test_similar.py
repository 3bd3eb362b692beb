"""SimHash groups, components and multiset fingerprints against brute force."""
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from textquarry.llm import fingerprint as P
from textquarry.llm import simhash as H
from textquarry.llm.components import components


def groups(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def slow(text):
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\v\f\r" else c for c in text or "").split(" ") if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_fingerprint_bits():
    for t in ["", "a", "a b c", "A b c d", "É b  c\td\ne f a b c d e", None, "x " * 5000, "one two three four five six " * 900]:
        assert H.fingerprint(t) == slow(t)


def test_trie_links():
    rng = np.random.default_rng(1)
    for _ in range(15):
        p = [int(x) for x in rng.integers(0, 2**63, 5, dtype=np.uint64)]
        for _ in range(150):
            x = p[rng.integers(len(p))]
            for _ in range(rng.integers(1, 6)):
                x ^= 1 << int(rng.integers(64))
            p.append(x)
        p = np.unique(np.array(p, np.uint64))
        near = [(i, i + 1 + int(j)) for i in range(len(p)) for j in np.flatnonzero(np.bitwise_count(p[i] ^ p[i + 1 :]) <= 4)]
        for leaf, frontier in ((H.LEAF, H.FRONTIER), (1, 10), (4, 1 << 20), (10**6, 50)):
            forest = H.trie_links(p, 4, leaf, frontier)
            assert all(int(p[a] ^ p[b]).bit_count() <= 4 for a, b in forest)
            assert groups(len(p), forest) == groups(len(p), near)
    for n in (1, 2, 3, 16, 17):
        p = np.arange(n, dtype=np.uint64)
        assert len(H.trie_links(p)) == n - 1


def test_crowded_bucket():
    """50,000 fingerprints that agree in two blocks: chains of near ones among random others."""
    rng = np.random.default_rng(3)
    p = rng.integers(0, 1 << 43, 50_000, dtype=np.uint64)
    for k in range(0, 40_000, 4):
        p[k + 1] = p[k] ^ np.uint64(0b1111)
        p[k + 2] = p[k + 1] ^ np.uint64(0b1111 << 30)
    p = np.unique(p)
    forest = H.trie_links(p)
    assert all(int(p[a] ^ p[b]).bit_count() <= 4 for a, b in forest) and len(forest) >= 19_990


@pytest.mark.parametrize("split", [3, 16_384])
def test_links_of_split_buckets(spark, split):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**62, 6, dtype=np.uint64)
    p = set()
    for _ in range(300):
        x = int(base[rng.integers(6)])
        for _ in range(int(rng.integers(1, 9))):
            x ^= 1 << int(rng.integers(64))
        p.add(x)
    p = sorted(p)
    at = {x - (1 << 64) if x >> 63 else x: k for k, x in enumerate(p)}
    near = [(a, b) for a in range(len(p)) for b in range(a) if (p[a] ^ p[b]).bit_count() <= 4]
    got = [(at[r.a], at[r.b]) for r in H.links(spark.createDataFrame([(x,) for x in at], "fp long"), split=split).collect()]
    assert groups(len(p), got) == groups(len(p), near)


def test_groups(spark):
    rng = random.Random(4)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(200)] for _ in range(8)]
    rows = [(None, "alone x y z"), (500, None), (501, ""), (502, "same"), (503, "same"), (503, "same")]
    for k in range(80):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 1, 2, 5, 30))):
            w[rng.randrange(len(w))] = rng.choice("qrst")
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in H.simhash_groups(docs).collect()), key=str)
    fps = [slow(t) for _, t in rows]
    of = groups(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    least = {}
    for (i, _), g in zip(rows, of, strict=True):
        least[g] = min([x for x in (least.get(g), i) if x is not None], default=None)
    assert got == sorted(((i, f, least[g]) for (i, _), f, g in zip(rows, fps, of, strict=True)), key=str)
    assert H.simhash_groups(docs.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 99), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 99: 99, 100: 99}


def slow_lanes(text):
    """The fingerprint by plain integers, a paragraph and a clause at a time."""
    exact, graded = [0] * 32, [0] * 512
    for line in text.split("\n") if text else []:
        d = hashlib.blake2b(line.encode(), digest_size=64, key=b"paragraph").digest()
        for k in range(32):
            exact[k] += d[2 * k] + 256 * d[2 * k + 1]
        for clause in re.findall(P._CLAUSE, line):
            d = hashlib.blake2b(clause.strip().encode(), digest_size=64, key=b"multiset").digest()
            for k in range(512):
                graded[k] += 1 if d[k // 8] >> (7 - k % 8) & 1 else -1
    return [x % 65536 for x in exact + graded]


def slow_likeness(a, b):
    if a == b:
        return 1.0
    signed = lambda v: v - 65536 if v >= 32768 else v
    square = lambda v: sum(signed(x) ** 2 for x in v)
    a, b = a[32:], b[32:]
    both = square(a) + square(b)
    return min(1.0, max(0.0, 1 - square([(x - y) % 65536 for x, y in zip(a, b, strict=True)]) / both)) if both else 0.0


def test_multiset_hash():
    f = P.fingerprint("a b. c\nd e.\nx")
    assert f.tolist() == slow_lanes("a b. c\nd e.\nx") and P.fingerprint("\n").tolist() == slow_lanes("\n")
    assert (f == P.fingerprint("x\na b. c\nd e.")).all() and not (f == P.fingerprint("a b. c\nd e.")).all()
    assert (P.insert(P.fingerprint("a b. c\nd e."), "x") == f).all() and (P.delete(f, "x") == P.fingerprint("a b. c\nd e.")).all()
    assert P.likeness(f, f) == 1 and P.likeness(P.fingerprint(""), P.fingerprint(None)) == 1 and P.likeness(f, P.fingerprint("")) == 0
    texts = ["alpha beta. gamma delta.\nepsilon zeta.", "alpha beta.\ngamma delta. epsilon zeta.", "epsilon zeta. alpha beta. gamma delta.", "gamma delta. alpha beta.\nepsilon zeta."]
    assert len({P.to_string(P.fingerprint(t)) for t in texts}) == 4
    long = "\n".join(f"line {k}, with two clauses" for k in range(5000)) + "\n" + "word. " * 5000
    assert P.fingerprint(long).tolist() == slow_lanes(long)


def test_compare_with_next(spark, monkeypatch):
    monkeypatch.setattr(P, "LEAST_ROWS", 4)
    rows = [(k, " ".join(f"w{k}x{j}." for j in range(k))) for k in range(37)] + [(None, "n"), (None, "m"), (5, None), (5, "b"), (5, "b"), (-(1 << 63), "least"), ((1 << 63) - 1, "most")]
    docs = spark.createDataFrame([(i, t, 1, "h") for i, t in rows], "doc_id long, text string, part int, h string")
    hashes = {r.text: r.x for r in docs.selectExpr("coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as x").collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]], r[1]))
    want = []
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        a, b, c = map(slow_lanes, (t, e, n))
        text = lambda v: b"".join(x.to_bytes(2, "little") for x in v).hex()
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), text(a), text(b), slow_likeness(a, b), slow_likeness(a, c)))
    for part_rows in (4, 1000):
        got = sorted(map(tuple, P.compare_with_next(docs, part_rows=part_rows).collect()), key=str)
        assert [g[:5] for g in got] == [w[:5] for w in sorted(want, key=str)]
        assert all(abs(x - y) < 1e-12 for g, w in zip(got, sorted(want, key=str), strict=True) for x, y in zip(g[5:], w[5:], strict=True))
    assert P.compare_with_next(docs.limit(0)).count() == 0 and P.compare_with_next(docs.limit(1)).count() == 1
    null = spark.range(3000).selectExpr("cast(null as long) as doc_id", "cast(id as string) as text")
    out = P.compare_with_next(null)
    assert out.count() == 3000 and out.rdd.getNumPartitions() > 1
