"""Near groups against the exact Jaccard similarity of all pairs."""
import random

import numpy as np

from textquarry.llm import near as N


def sets(text, size=5):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def similar(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute(texts):
    of = [sets(t) for t in texts]
    root = list(range(len(of)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(of)):
        for j in range(i):
            if similar(of[i], of[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(x) for x in range(len(of))]


def made(rng):
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) + rng.choice("xyz") for _ in range(rng.choice((6, 40, 200)))) for _ in range(12)]
    out = [None, "", "  ", "same words here", "Same  words here"]
    for _ in range(150):
        w = rng.choice(base).split()
        for _ in range(rng.choice((0, 1, 1, 2, 4, 20))):
            w[rng.randrange(len(w))] = rng.choice("klm") * 3
        out.append(" ".join(w))
    return out


def test_groups(spark):
    texts = made(random.Random(6))
    docs = spark.createDataFrame([(k, t, "clash", 1) for k, t in enumerate(texts)], "id long, text string, node string, bucket int")
    got = {r.id: r.component_id for r in N.near_groups(docs, "id").collect()}
    want = brute(texts)
    same = lambda of: {(i, j) for i in range(len(texts)) for j in range(i) if of[i] == of[j]}
    assert same(got) == same(want)
    assert N.near_groups(docs.limit(0), "id").count() == 0


def test_budget_loses_no_near_pair():
    rng = random.Random(7)
    worst = 0
    for _ in range(3000):
        w = [f"{rng.random():.6f}" for _ in range(rng.choice((8, 12, 20, 50, 300)))]
        v = list(w)
        for _ in range(max(1, len(w) // 60)):
            v[rng.choice((0, -1, rng.randrange(len(v))))] = "other"
        a, b = " ".join(w), " ".join(v)
        if similar(sets(a), sets(b)) >= 0.8:
            x, y = (N.simhash(N.hashes(N.shingles(t))) for t in (a, b))
            worst = max(worst, ((x ^ y) & (1 << 64) - 1).bit_count())
    assert 8 < worst <= N.WRONG


def test_trie_finds_the_pairs(spark, monkeypatch):
    """Pairs come from the binary-trie self-join: of all fingerprints within its bits, and of the bands' buckets."""
    seen = set()
    rng = random.Random(8)
    points = np.sort(np.array([rng.getrandbits(64) ^ 0 for _ in range(30)] + [0xFFFF ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(40)], np.uint64))
    near = {(i, j) for j in range(70) for i in range(j) if int(points[i] ^ points[j]).bit_count() <= N.WRONG}
    for most in (4, 10**6):
        found = N.Candidates(np.full(70, 9), np.arange(70), 0.8, most)
        got = {p for x, y in N.trie_links(points, N.WRONG, into=found) for p in zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist(), strict=True)}
        seen.add((got == near, found.cut))
        assert got <= near
    assert seen == {(False, True), (True, False)}


def test_no_link_is_left_to_a_leader(spark, monkeypatch):
    """A bucket of many nodes where each is like a few alone: chains that few candidates a node don't show at once."""
    monkeypatch.setattr(N, "bands", lambda h: np.zeros(N.BANDS, np.int64))
    monkeypatch.setattr(N, "PARTNERS", 1)
    rng = random.Random(9)
    texts = []
    for _ in range(3):
        w = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        for _ in range(12):
            texts.append(" ".join(w))
            w = w[4:] + [f"w{rng.randrange(10**6)}" for _ in range(4)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string")
    got = {r.id: r.component_id for r in N.near_groups(docs, "id").collect()}
    want = brute(texts)
    assert len(set(want)) == 3
    assert {(i, j) for i in got for j in range(i) if got[i] == got[j]} == {(i, j) for i in got for j in range(i) if want[i] == want[j]}
