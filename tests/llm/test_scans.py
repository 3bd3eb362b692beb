"""Secret scans and decontamination against brute force."""
import hashlib
import math
import random
import re
from collections import Counter

from textquarry.llm import decontaminate as D
from textquarry.llm import secrets as S


def brute_windows(text, a, b, bits, w):
    hit = set()
    for k in range(a, b - w + 1):
        c = Counter(text[k : k + w])
        if -sum(n / w * math.log2(n / w) for n in c.values()) >= bits - 1e-9:
            hit |= set(range(k, k + w))
    return hit


def test_windows():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("aabbccdefgh0123") for _ in range(rng.randint(5, 60)))
        spans = S.windows(text, 2, len(text), 2.8, 10)
        assert {k for s, e in spans for k in range(s, e)} == brute_windows(text, 2, len(text), 2.8, 10)


def test_base_spans(spark):
    key, hx = "AKIA" + "ABCD1234" * 2, "0123456789abcdef" * 2
    text = f"é Password = 'hunter2hunter2' token:short secret=\"abcdefgh\" {key} {hx} AKIASHORT aB3dE5fG7hI9jK1lM3nO5p"
    rows = [(1, text), (2, None), (3, ""), (4, "the quick brown fox " * 300)]
    got = {r.doc_id: r for r in S.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    kinds = [(s.kind, text[s.start : s.end]) for s in got[1].secrets]
    assert ("access", key) in kinds and ("hex", hx) in kinds and sum(k == "assign" for k, _ in kinds) == 2
    assert [k for k in kinds if k[0] == "entropy"] == [("entropy", "aB3dE5fG7hI9jK1lM3nO5p")]
    assert not got[2].secrets and not got[3].secrets and not got[4].secrets


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, n=5):
    out = {}
    grams = {i: [w[k : k + n] for k in range(max(1, len(w) - n + 1))] for i, t in items if (w := words(t))}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, gs in grams.items():
            for g in gs:
                for k in range(len(w) - len(g) + 1):
                    if w[k : k + len(g)] == g:
                        hit |= set(range(k, k + len(g)))
                        found.add(str(i))
        out[d] = (len(w), len(hit), sorted(found))
    return out


def test_decontamination(spark, monkeypatch):
    rng = random.Random(2)
    text = lambda lo, hi: " ".join(rng.choice(["aa", "bb", "Cc", "dd,", "é"]) for _ in range(rng.randint(lo, hi)))
    items = [(i, text(0, 12)) for i in range(30)] + [(30, None), (31, "Aa bb"), (31, "Aa bb"), (None, "zz zz")]
    docs = [(d, text(0, 40)) for d in range(60)] + [(60, None), (61, ""), (62, "x " * 5000 + "aa bb zz zz")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, [i for i in items if i[0] is not None], 5)
    for block, most in ((1 << 20, 4), (60, 2), (9, 1000)):
        monkeypatch.setattr(D, "BLOCK_CHARS", block)
        monkeypatch.setattr(D, "PASS_BLOCKS", most)
        got = {r.doc_id: r.contamination for r in D.find_contamination(df, bench, window=5).collect()}
        for d, (n, hit, found) in want.items():
            assert (got[d].n_words, got[d]["items"]) == (n, found)
            if d != 62:
                assert sum(s.end - s.start for s in got[d].spans) == hit
    for n in (1, 4, 5, 6, 30, 31):  # the parts of a long item hold each of its windows, and no other
        found = [f"w{k}" for k in range(n)]
        parts = [p.split() for p in D.parts_of(" ".join(found), 5, 20)]
        windows = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        assert set().union(*map(windows, parts)) == windows(found) and (n >= 5 or parts == [found])
    clash = df.selectExpr("*", "1 as __found", "2 as __cut", "3 as contamination", "4 as n_chars")
    assert D.decontaminate(clash, bench, window=5).columns == clash.columns
    assert D.cut_words("One, two; three four!", [(1, 3)]) == "One,  four!"
    kept = {r.doc_id: r.text for r in D.decontaminate(spark.createDataFrame([(1, "a b c " * 100 + "q w e r t"), (2, "q w e r t"), (3, None)], "doc_id long, text string"), spark.createDataFrame([(1, "q w e r t")], "item_id long, text string"), window=5).collect()}
    assert set(kept) == {1, 3} and "q w" not in kept[1]
    assert D.find_contamination(df.limit(0), bench).count() == 0 and D.find_contamination(df, bench.limit(0)).count() == len(docs)
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
