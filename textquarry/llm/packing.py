"""Best-fit packing of tokenized documents, improved by a swap-based local search.

Documents are cut into pieces of at most ``capacity`` ids (the first piece takes the odd length). A full piece is a sequence
by itself and goes nowhere. The others are dealt by a hash of their place in the stored table into groups of about ``GROUP``
pieces, so neither keys nor copies nor long documents decide a group's size, and each group is packed in one task: best fit
by falling length, then a local search that takes the emptiest sequence and moves a piece into another one, exchanges one
piece for one, or two for one, whenever the sum of squared fills rises, until the sequence is empty. The search ends at the
bound of ceil(ids / capacity) sequences, or when each underfull sequence has been tried and none of these steps is left for it.

Defined results: null text counts as empty, a document of the end id alone; rows with the same doc_id, equal rows among them,
are packed each on its own, and (doc_id, piece) is unique where no doc_id comes twice; a text of any length is encoded whole;
other columns are left out, whatever their names; an empty table gives no rows. With ``with_ids`` the pieces carry their ids,
which are joined to the packed pieces by their place and never enter a group.
"""
from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, release, stored, table
from .encoder import encoder

CAPACITY = 2048
GROUP = 32_768
TOKENIZER, END_ID = "byte_bpe_50k.json", 0
PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of n ids; the first takes what full pieces leave."""
    odd = n % capacity
    borders = [0, *range(odd or capacity, n + 1, capacity)]
    return list(zip(borders[:-1], borders[1:], strict=True))


def encode_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """A row for each piece, numbered by ``row``; ``with_ids`` adds the piece's ids."""
    schema = PIECES + (", ids array<int>" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(doc_ids), 512):
                rows, flat = [], []
                for doc_id, ids in zip(doc_ids[at : at + 512], own.encode(texts.slice(at, 512).to_pylist()), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    flat.append(ids)
                    for k, (a, b) in enumerate(cut(len(ids), capacity)):
                        rows.append((row, doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                        row += 1
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                if with_ids:  # pieces follow each other in the ids
                    ends = np.concatenate(([0], np.cumsum([r[4] for r in rows]))).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat).view(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)
        release(own.forget)

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(pieces, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item places: longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit f: there is a bin with f free
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        fit = mask >> size
        if fit:
            free = size + (fit & -fit).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                mask ^= 1 << free
        else:
            free, b = capacity, len(bins)
            bins.append([])
        bins[b].append(item)
        by_free[free - size].append(b)
        mask |= 1 << (free - size)
    return bins


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Empties bins by moves and exchanges that raise the sum of squared fills."""
    bins = [list(b) for b in bins]
    owner = np.zeros(len(lengths), np.int64)
    for k, b in enumerate(bins):
        owner[b] = k
    fill = np.bincount(owner, lengths, len(bins)).astype(np.int64) if len(bins) else np.zeros(0, np.int64)
    least = -(-int(lengths.sum()) // capacity)
    left = len(bins)
    reach: np.ndarray | None = None  # by length n: the longest that could take the place of an item of at most n

    def put(item: int, to: int) -> None:
        nonlocal reach
        reach = None
        bins[owner[item]].remove(item)
        fill[owner[item]] -= lengths[item]
        bins[to].append(item)
        fill[to] += lengths[item]
        owner[item] = to

    def reachable() -> np.ndarray:
        room = np.full(capacity + 1, -capacity - 1)
        np.maximum.at(room, lengths, (capacity - fill)[owner])
        return np.maximum.accumulate(room + np.arange(capacity + 1))

    def improve(donor: int) -> bool:
        """One step out of the donor; the fuller side of every step gets fuller."""
        nonlocal reach
        by_length: dict[int, list[int]] = defaultdict(list)
        for i in bins[donor]:
            by_length[int(lengths[i])].append(i)
        sizes = sorted(by_length, reverse=True)
        free = capacity - fill
        free[donor] = -1
        free[fill == 0] = -1
        most = int(free.max())
        for n in sizes:
            if n > most:
                continue
            fits = np.where(free >= n, free, capacity + 1)
            to = int(fits.argmin())
            if fill[to] + n > fill[donor]:
                put(by_length[n][0], to)
                return True
        if reach is None:
            reach = reachable()
        room = None
        singles = [(n, (by_length[n][0],)) for n in sizes]
        pairs = [(2 * n, tuple(by_length[n][:2])) for n in sizes if len(by_length[n]) > 1]
        pairs += [(a + b, (by_length[a][0], by_length[b][0])) for a, b in combinations(sizes, 2)]
        for size, give in singles + sorted(dict(pairs).items(), reverse=True):
            if reach[min(size - 1, capacity)] < size:
                continue
            room = free[owner] if room is None else room
            gain = size - lengths
            good = (gain > 0) & (room >= gain) & (fill[owner] + gain > fill[donor])
            if good.any():
                take = int(np.where(good, room - gain, capacity + 1).argmin())
                to = int(owner[take])
                put(take, donor)
                for i in give:
                    put(i, to)
                return True
        return False

    failed = np.zeros(len(bins), bool)
    while left > least:
        open_bins = np.where((fill > 0) & (fill < capacity) & ~failed, fill, capacity + 1)
        donor = int(open_bins.argmin())
        if open_bins[donor] > capacity:
            break
        while bins[donor] and improve(donor):
            pass
        if bins[donor]:
            failed[donor] = True
        else:
            left -= 1
    return [b for b in bins if b]


def pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item."""
    which, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, b in enumerate(local_search(best_fit(lengths, capacity), lengths, capacity)):
        which[b] = k
        offset[b] = np.concatenate(([0], np.cumsum(lengths[b])[:-1]))
    return which, offset


def pack_documents(
    docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id",
    text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """The pieces of all documents with their sequence and their place in it."""
    made = stored(encode_pieces(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), tokenizer, end_id, capacity, with_ids))
    pieces = made.drop("ids")
    groups = max(1, -(-pieces.where(F.col("length") < capacity).count() // GROUP))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="pack_group").sort_values("row", ignore_index=True)
        which, offset = pack(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=(int(key[0]) << 32) + which, offset=offset)

    full = pieces.where(F.col("length") == capacity).select("*", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    dealt = pieces.where(F.col("length") < capacity).withColumn("pack_group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
    out = full.unionByName(dealt.groupBy("pack_group").applyInPandas(packed, schema))
    return (out.join(made.select("row", "ids"), "row") if with_ids else out).drop("row")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
