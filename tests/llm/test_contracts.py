"""The opN_ queries over the smallest tables against brute force written from their contracts."""
import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from textquarry.llm import registry
from textquarry.llm.encoder import tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def rows(spark, name):
    return [r.asDict() for r in registry.QUERIES[name](spark, SF).collect()]


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_op2(spark):
    got = {r["doc_id"]: r for r in rows(spark, "op2_language")}
    assert len(got) == len(DOCS)
    right = []
    for i, t, lang in DOCS:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i]["score"] <= 1
        assert (got[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or ""))
        if got[i]["held_out"] and lang:
            right.append(got[i]["lang_pred"] == lang)
    assert sum(right) >= 0.95 * len(right) > 20


def test_op3(spark):
    got = {r["doc_id"]: r for r in rows(spark, "op3_secret_scan")}
    for i, t, _ in DOCS:
        found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t or "") if len(m[1]) >= 8]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 16]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 32]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))
        r = got[i]
        assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(k == x for _, x, _ in found) for k in range(3)]
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert ",".join(x for x in r["spans"].split(",") if not x.startswith("entropy")) == text


def test_op5(spark):
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t, _ in DOCS}
    got = rows(spark, "op5_packing")
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i, own in ids.items():
        own_pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own_pieces] == list(range(-(-len(own) // 2048)))
        at = 0
        for r in own_pieces:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(own[at : at + r["length"]].tobytes())
            assert r["length"] == 2048 or r["piece"] == 0
            at += r["length"]
        assert at == len(own)
    for s in by_seq.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == [sum(x["length"] for x in s[:k]) for k in range(len(s))] and sum(r["length"] for r in s) <= 2048
    assert len(by_seq) == -(-sum(map(len, ids.values())) // 2048)


def test_op6(spark):
    got = {r["doc_id"]: r for r in rows(spark, "op6_fingerprint")}
    order = sorted(DOCS, reverse=True)
    prints = {}
    for (i, t, _), (_, n, _) in zip(order, order[1:] + order[:1], strict=True):
        t, half, r = t or "", len(t or "") // 2, got[i]
        changed = t[: len(t) - half] + (n or "")[:half]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"] and (r["fingerprint"] == r["edited_fingerprint"]) == (sorted(t.split("\n")) == sorted(changed.split("\n")))
    assert len(set(prints.values())) == len({tuple(sorted(t.split("\n"))) for t in prints})
    assert sum(r["near_edited"] > r["near_next"] for r in got.values()) > 0.95 * len(got)


def test_op7(spark):
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    at, want = 0, []
    for i, t, _ in DOCS:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in rows(spark, "op7_token_files")) == want


def test_op9(spark):
    prints = []
    for _, t, _ in DOCS:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(DOCS)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(DOCS)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = [(i, f"{p:016x}", DOCS[find(k)][0]) for k, ((i, _, _), p) in enumerate(zip(DOCS, prints, strict=True))]
    assert sorted(tuple(r[c] for c in ("doc_id", "fingerprint", "component_id")) for r in rows(spark, "op9_simhash")) == want


def test_op10(spark):
    """The pages of the smallest tables hold one article each, whose blocks are headings and paragraphs."""
    import html

    pages = {i: h for i, h in duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall()}
    for r in rows(spark, "op10_html_text"):
        inside = (re.search(r"<article>(.*?)(?:</article>|$)", pages[r["page_id"]] or "", re.DOTALL) or ["", ""])[1]
        parts = re.split(r"</?(?:p|h1)>", inside)
        want = "\n\n".join(x for x in (" ".join(html.unescape(re.sub("<[^>]*>", " " if "<br" in p else "", p)).split()) for p in parts) if x)
        assert r["text"] == want and r["n_chars"] == len(want)


@pytest.mark.parametrize("name", ["op1_decontamination", "op4_chat_format", "op8_line_dedup"])
def test_rows(spark, name):
    assert len(rows(spark, name)) >= 20
