"""The encoder, packing and token files against the tokenizers library itself."""
import os
import random
import zlib
from functools import cache

os.environ["TOKENIZERS_PARALLELISM"] = "false"
import numpy as np
import pytest
from tokenizers import Tokenizer

from textquarry.llm import packing, token_files
from textquarry.llm.common import shared_dir
from textquarry.llm.encoder import encoder, tokenizer_path

ODD = ["a", "é", "ß", "Ж", "1", "٣", " ", "  ", "\n", "\t", "'", "'s", "'t", "!", "-", "<|endoftext|>", " ", "́", "ſ", "中", "\U0001f600", "\x1c", "　", "_", "The", "\r\n", "İ", "Σ", "½", "ﬁ", "é", "×", "...", " '", '"']


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_library(name, monkeypatch):
    from textquarry.llm import encoder as module

    monkeypatch.setattr(module, "KEPT_CHUNKS", 500)
    own, library = module.Encoder(name), Tokenizer.from_file(tokenizer_path(name))
    some = [*texts(3000), "word " * 2000, "x" * 5000, "", None]
    got = own.encode(some)
    assert [g.tolist() for g in got] == [e.ids for e in library.encode_batch([t or "" for t in some], add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_letter_runs_go_to_the_model(name, monkeypatch):
    """All Latin letters, alone and in runs, as the library has them; none goes through the library's steps for texts."""
    from textquarry.llm import encoder as module

    own, library = module.Encoder(name), Tokenizer.from_file(tokenizer_path(name))
    rng = random.Random(3)
    letters = [chr(c) for c in range(0x250) if module._WORD(chr(c))]
    some = [*letters, *(" ".join("".join(rng.choice(letters[: rng.choice((52, 400))]) for _ in range(rng.randint(1, 70))) for _ in range(9)) for _ in range(200))]
    whole = []

    class Spy:
        def encode_batch_fast(self, chunks, **kw):
            whole.extend(chunks)
            return library.encode_batch_fast(chunks, **kw)

    monkeypatch.setattr(own, "tokenizer", Spy())
    assert [g.tolist() for g in own.encode(some)] == [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
    assert len(letters) > 400 and not whole


def test_no_cache_outlives_a_task(spark):
    """A reused worker that another stage's tasks pass by keeps nothing."""
    docs = spark.createDataFrame([(k, f"word{k} some") for k in range(40)], "doc_id long, text string").repartition(2)
    packing.encode_pieces(docs, packing.TOKENIZER, 0, 64).collect()

    def kept(batches):
        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(encoder(packing.TOKENIZER).place)], pa.int64())})

    assert {r.n for r in docs.select("doc_id").mapInArrow(kept, "n long").collect()} == {0}


ROWS = [(3, "c c c"), (1, None), (2, ""), (1, None), (None, "nobody"), (4, "word " * 5000), *((k, t) for k, t in enumerate(texts(150), 10))]


@cache
def _library(name):
    return Tokenizer.from_file(tokenizer_path(name))


def _ids(name, text, end):
    return np.array([*_library(name).encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("group", [packing.GROUP, 20])
def test_packing(spark, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP", group)
    docs = spark.createDataFrame([(i, t, 9, "g") for i, t in ROWS], "doc_id long, text string, length int, row string")
    rows = packing.pack_documents(docs, capacity=64, with_ids=True).toPandas()
    want = sorted(zlib.crc32(_ids(packing.TOKENIZER, t, 0).tobytes()) for _, t in ROWS)
    for r in rows.itertuples():
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= 64
        assert r.piece == 0 or r.length == 64
    once = {i for i, _ in ROWS if sum(i == j for j, _ in ROWS) == 1 and i is not None}
    whole = [zlib.crc32(np.concatenate(g.sort_values("piece")["ids"].tolist()).astype("<u4").tobytes()) for i, g in rows.groupby("doc_id") if i in once]
    assert sorted(whole) == sorted(zlib.crc32(_ids(packing.TOKENIZER, t, 0).tobytes()) for i, t in ROWS if i in once) and set(whole) <= set(want)
    assert rows["length"].sum() == sum(len(_ids(packing.TOKENIZER, t, 0)) for _, t in ROWS)
    for _, s in rows.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["length"].sum() <= 64 and s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]]
    if group > 20:
        assert rows["sequence_id"].nunique() == -(-rows["length"].sum() // 64)  # as few as there can be
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_books_stay_out_of_groups(spark, monkeypatch):
    """Only what doesn't fill a sequence is handed to a group."""
    book = "word " * 300_000
    docs = spark.createDataFrame([(k, book if k % 5 == 0 else "a few words") for k in range(30)], "doc_id long, text string")
    rows = packing.pack_documents(docs).toPandas()
    full = rows[rows["length"] == packing.CAPACITY]
    assert len(full) > 600 and full["sequence_id"].is_unique and (full["sequence_id"] < 0).all()
    assert (rows[rows["length"] < packing.CAPACITY]["sequence_id"] >= 0).all()


def brute_bins(lengths, capacity):
    """The fewest bins, by trying all."""
    best = len(lengths)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[k] <= capacity:
                place(k + 1, [*bins[:b], bins[b] + lengths[k], *bins[b + 1 :]])
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best


def test_local_search_empties_bins():
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = rng.integers(20, 60, 120)
        start = [[k] for k in range(120)]
        better = packing.local_search(start, lengths, 100)
        assert sorted(i for b in better for i in b) == list(range(120)) and all(lengths[b].sum() <= 100 for b in better)
        assert len(better) < 0.62 * 120
    over = 0
    for _ in range(60):
        lengths = rng.integers(10, 60, 9)
        over += len(packing.local_search(packing.best_fit(lengths, 100), lengths, 100)) - brute_bins(sorted(lengths.tolist(), reverse=True), 100)
    assert over <= 3
    many = packing.local_search(packing.best_fit(np.full(3000, 1100), 2048), np.full(3000, 1100), 2048)  # nothing to gain
    assert len(many) == 3000
    assert packing.cut(5, 2) == [(0, 1), (1, 3), (3, 5)] and packing.cut(4, 2) == [(0, 2), (2, 4)] and packing.cut(1, 2) == [(0, 1)]


def test_token_files(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    manifest = token_files.write_token_files(docs, shared_dir(spark), shard_docs=40)
    rows = token_files.read_token_files(manifest).orderBy("start").collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    ids = [_ids(token_files.TOKENIZER, t, 1) for _, t in order]
    assert [r.doc_id for r in rows] == [i for i, _ in order]
    assert [(r.n_tokens, r.ids_crc32) for r in rows] == [(len(x), zlib.crc32(x.tobytes())) for x in ids]
    assert [r.start for r in rows] == np.cumsum([0] + [len(x) for x in ids])[:-1].tolist()
    shard = manifest.orderBy("shard").first()
    assert token_files.read_record(shard.path, 1)[1].tolist() == ids[1].tolist()
    assert token_files.read_token_files(token_files.write_token_files(docs.limit(0), shared_dir(spark))).count() == 0


def test_damage_is_found():
    data = bytearray(token_files.record(b"payload"))
    token_files.payload_at(memoryview(bytes(data)), 0)
    for at in (0, 14):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            token_files.payload_at(memoryview(bytes(bad)), 0)
