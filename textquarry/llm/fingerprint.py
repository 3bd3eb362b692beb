"""Homomorphic multiset fingerprints of documents.

A text is a multiset of paragraphs (lines). A paragraph's vector has two parts, both functions of that paragraph alone: the
``EXACT`` lanes are its keyed BLAKE2b digest, read as 16-bit numbers; the ``LANES`` lanes after them are the sum, over its
clauses with their repeats, of signs out of the clauses' digests, one bit a lane. A document's fingerprint is the sum of its
paragraphs' vectors modulo 2**16 in each lane: the order of paragraphs doesn't matter, adding or removing a paragraph adds
or subtracts its vector, and fingerprints of partitions add up. Texts of unequal multisets of paragraphs differ in the exact
lanes, whatever clauses they share.

The other lanes grade how like two texts are. Since the signs of unequal clauses are independent, the mean square of a
fingerprint's lanes estimates the squared norm of the multiset of clauses, and that of a difference the squared norm of the
multisets' difference; likeness is 1 - difference / (both norms), held within 0 to 1.

``op6`` compares each document with its edited text and with the next document. Rows are dealt to parts by ranges of falling
doc_id (and the text's hash, so that one doc_id may fill several parts), found on those two columns alone: the driver holds
one pair of numbers a part of ``PART_ROWS`` rows. The first row of each part goes to the part before it as well, so the text
is shuffled once; each part is a task of its own, which holds the current and the next row.

Defined results: null text counts as empty; the empty text has no paragraph and the zero fingerprint, whose likeness to
itself is 1 and to any other 0; rows with the same doc_id are ordered by their text's hash, then the text; null doc_ids come
last; equal rows follow each other; a table of one row is its own next; an empty table gives no rows; a text of any length is
read whole, in batches of clauses; other columns are left out, whatever their names (``fingerprint_documents`` keeps them and
replaces one of the result's name). A lane wraps only beyond 32,767 net equal signs; equality and updates stay exact then.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, table

EXACT, LANES, KEY, CLAUSE_KEY = 32, 512, b"paragraph", b"multiset"
#: Rows of a part, about; and the fewest that a part is made of where there are parts enough for all tasks.
PART_ROWS, LEAST_ROWS = 32_768, 1024
# A clause: up to eight words (a longer word counts as several) and the stop, comma or colon after them.
_CLAUSE = re.compile(r"(?:[^\s.!?,;:]{1,64}[ \t]*){1,8}[.!?,;:]*\s*|[.!?,;:]+\s*|\s+")


def _digest(of: str, size: int, key: bytes) -> bytes:
    return blake2b(of.encode("utf-8", "surrogatepass"), digest_size=size, key=key).digest()


def _signs(digests: list[bytes]) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, LANES // 8), axis=1)
    return 2 * bits.sum(0, dtype=np.int64) - len(bits)


def fingerprint(text: str | None) -> np.ndarray:
    """uint16 lanes of a whole text. Added and subtracted lane by lane."""
    return of_paragraphs(text.split("\n") if text else [])


def of_paragraphs(paragraphs: list[str]) -> np.ndarray:
    """The sum of the paragraphs' vectors."""
    total = np.zeros(EXACT + LANES, np.int64)
    # The vectors of all paragraphs add up, so the clauses of many short ones go through one call.
    whole: list[bytes] = []
    clauses: list[bytes] = []

    def add() -> None:
        if whole:
            total[:EXACT] += np.frombuffer(b"".join(whole), "<u2").reshape(-1, EXACT).sum(0, dtype=np.int64)
        if clauses:
            total[EXACT:] += _signs(clauses)
        whole.clear()
        clauses.clear()

    for paragraph in paragraphs:
        whole.append(_digest(paragraph, 2 * EXACT, KEY))
        for m in _CLAUSE.finditer(paragraph):
            clauses.append(_digest(m[0].strip(), LANES // 8, CLAUSE_KEY))
            if len(clauses) >= 2048:
                add()
        if len(whole) >= 2048:
            add()
    add()
    return (total & 0xFFFF).astype(np.uint16)


def insert(of: np.ndarray, paragraph: str) -> np.ndarray:
    return of + of_paragraphs([paragraph])


def delete(of: np.ndarray, paragraph: str) -> np.ndarray:
    return of - of_paragraphs([paragraph])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated overlap of two multisets from their fingerprints, 0 to 1."""
    x, y = a[EXACT:].view(np.int16).astype(np.int64), b[EXACT:].view(np.int16).astype(np.int64)
    d = (a - b)[EXACT:].view(np.int16).astype(np.int64)
    if (a == b).all():
        return 1.0
    both = int(x @ x + y @ y)
    return min(1.0, max(0.0, 1 - int(d @ d) / both)) if both else 0.0


def to_string(of: np.ndarray) -> str:
    return of.astype("<u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_documents(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint as bytes, little-endian lanes."""

    @F.pandas_udf("binary")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(t).astype("<u2").tobytes() for t in batch], dtype=object)

    return docs.withColumn(out_col, each(F.col(text_col)))


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(doc_id: int | None, text: str, own: np.ndarray, following: str, next_print: np.ndarray) -> tuple:
    changed = edited(text, following)
    print_ = fingerprint(changed)
    return (doc_id, len(text), sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), to_string(own), to_string(print_), likeness(own, print_), likeness(own, next_print))


def _packed(missing, falling, h) -> np.ndarray:
    """Keys as byte strings that sort like them."""
    out = np.zeros((len(missing), 17), np.uint8)
    out[:, 0] = np.asarray(missing, bool)
    for at, values in ((1, falling), (9, h)):
        shifted = np.asarray(values, np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        out[:, at : at + 8] = shifted.astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("S17").ravel()


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_rows: int = PART_ROWS) -> DataFrame:
    """The rows of ``OUT`` for every document: its fingerprint beside that of its edited text and of the next document."""
    kinds = dict(x.split() for x in OUT.split(", "))
    arrow = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    # What sorts like falling doc_ids, null last, then the hash.
    key = [F.col("doc_id").isNull().alias("missing"), F.bitwise_not(F.coalesce("doc_id", F.lit(0))).alias("falling"), F.col("h")]
    ids = rows.select(*key)
    count = docs.count()
    at_least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    n = max(1, -(-count // part_rows), min(at_least, count // LEAST_ROWS))
    ranges = ids.repartitionByRange(n, *ids.columns).select(F.spark_partition_id().alias("p"), F.struct(*ids.columns).alias("k"))
    heads = sorted(tuple(r["k"]) for r in ranges.groupBy("p").agg(F.min("k").alias("k")).collect())
    packed = np.array([_packed([m], [f], [h])[0] for m, f, h in heads]) if heads else np.zeros(0, "S17")

    def places_of(missing: pd.Series, falling: pd.Series, h: pd.Series) -> pd.Series:
        keys = _packed(missing, falling, h)
        own = np.searchsorted(packed, keys, "right") - 1
        first = packed[own] == keys  # the part before needs these rows too
        return pd.Series([[{"part": p, "guest": 0}] + ([{"part": (p - 1) % len(packed), "guest": 1}] if f else []) for p, f in zip(own.tolist(), first.tolist(), strict=True)], dtype=object)

    places = F.pandas_udf(places_of, "array<struct<part:int,guest:int>>")
    order = [F.col("doc_id").desc_nulls_last(), F.col("h"), F.col("text")]
    dealt = rows.select("doc_id", "text", "h", F.inline(places(*key))).repartitionById(max(1, len(heads)), F.col("part")).sortWithinPartitions("guest", *order).select("doc_id", "text", "part", "guest")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, over = None, None, False
        for batch in batches:
            found = []
            for doc_id, text, own_part, guest in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if own_part != at:
                    last, at, over = None, own_part, False
                if over:
                    continue  # further guests of the same doc_id
                text = text.as_py()
                own = fingerprint(text)
                if last is not None:
                    found.append(_compare(*last, text, own))
                last, over = (doc_id, text, own), guest == 1
            columns = list(zip(*found, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, arrow[k]) for c, k in zip(columns, kinds.values(), strict=True)], [*kinds])

    return dealt.mapInArrow(each, OUT)


def op6_fingerprint(spark, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
