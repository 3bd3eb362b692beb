"""Token-id files of length-delimited records with masked checksums, and an offset index beside each file.

Record: length of the payload (u64), its masked CRC-32 (u32), the payload, its masked CRC-32 (u32); all little-endian.
The mask is ((crc >> 15 | crc << 17) + 0xa282ead8) mod 2**32. Payload: doc_id (i64), whether it is null (u8), then the ids
as u16, or as u32 where the vocabulary needs it. A file starts with ``MAGIC`` and the width of an id. Index entry: offset of
the record (u64) and its number of ids (u64), so a reader can take records in any order.

Documents are range-partitioned by doc_id; partition k writes shard k in ascending doc_id order under a name of its own
and then renames it, so a repeated task leaves the same file. Shards go to the shared folder through pyarrow's file
systems.

Defined results: null text counts as empty, the end id alone; null doc_ids come first; rows with one doc_id are ordered by
text; equal rows are records of their own; a text of any length is encoded whole; other columns are left out, whatever their
names; an empty table gives no records.
"""
from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, release, shared_dir, stored, table
from .encoder import encoder

TOKENIZER, END_ID = "word_bpe_49k.json", 1
#: Documents of a shard, about.
SHARD_DOCS = 4096
MAGIC = b"TQIDS1\0"
HEAD, FOOT, ENTRY, OWN = "<QI", "<I", "<QQ", "<qB"
HEAD_SIZE, FOOT_SIZE, ENTRY_SIZE, OWN_SIZE = map(struct.calcsize, (HEAD, FOOT, ENTRY, OWN))
MANIFEST = "shard int, path string, n_docs long, n_tokens long, bytes long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def record(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack(FOOT, masked(length)) + payload + struct.pack(FOOT, masked(payload))


def payload_at(data: memoryview, at: int) -> memoryview:
    """The payload of the record at an offset; a wrong checksum is an error."""
    length, crc = struct.unpack_from(HEAD, data, at)
    if crc != masked(bytes(data[at : at + 8])):
        raise ValueError(f"the length at {at} is damaged")
    body = data[at + 12 : at + 12 + length]
    if masked(body) != struct.unpack_from(FOOT, data, at + 12 + length)[0]:
        raise ValueError(f"the record at {at} is damaged")
    return body


def ids_of(payload: memoryview, width: int) -> tuple[int | None, np.ndarray]:
    doc_id, missing = struct.unpack_from(OWN, payload)
    return None if missing else doc_id, np.frombuffer(payload[OWN_SIZE :], f"<u{width}").astype("<u4")


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
    shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """Writes the shards and returns the stored manifest, a row for each."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shards = max(1, -(-rows.count() // shard_docs))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        width = 2 if max(own.size, end_id + 1) <= 1 << 16 else 4
        shard = TaskContext.get().partitionId()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name, part = f"{root}/{shard:07d}", f"{root}/.{uuid.uuid4().hex}"
        n_docs = n_tokens = 0
        index, at = [], len(MAGIC) + 1
        with fs.open_output_stream(part) as out:
            out.write(MAGIC + bytes([width]))
            for batch in batches:
                doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
                for k in range(0, len(doc_ids), 512):
                    for doc_id, ids in zip(doc_ids[k : k + 512], own.encode(texts.slice(k, 512).to_pylist()), strict=True):
                        body = np.append(ids, np.uint32(end_id)).astype(f"<u{width}").tobytes()
                        framed = record(struct.pack(OWN, doc_id or 0, doc_id is None) + body)
                        out.write(framed)
                        index.append(struct.pack(ENTRY, at, len(body) // width))
                        at += len(framed)
                        n_docs += 1
                        n_tokens += len(body) // width
        release(own.forget)
        with fs.open_output_stream(f"{part}.index") as out:
            out.write(b"".join(index))
        fs.move(f"{part}.index", f"{name}.index")
        fs.move(part, f"{name}.records")
        if n_docs:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{folder}/{shard:07d}"], "n_docs": [n_docs], "n_tokens": [n_tokens], "bytes": [at]})

    dealt = rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return stored(dealt.mapInArrow(write, MANIFEST))


def read_record(path: str, k: int) -> tuple[int | None, np.ndarray]:
    """Record k of a shard by its index alone: what a shuffled reader does."""
    fs, root = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(f"{root}.index") as f:
        at, _ = struct.unpack(ENTRY, f.read_at(ENTRY_SIZE, k * ENTRY_SIZE))
    with fs.open_input_file(f"{root}.records") as f:
        width = f.read_at(1, len(MAGIC))[0]
        length = struct.unpack(HEAD, f.read_at(HEAD_SIZE, at))[0]
        return ids_of(payload_at(memoryview(f.read_at(HEAD_SIZE + length + 4, at)), 0), width)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """A row for each record of the shards: doc_id, the ids before it, and the number and checksum of its ids."""
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.select("shard", "path", before.alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                fs, root = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(f"{root}.index") as f:
                    entries = [*struct.iter_unpack(ENTRY, f.read())]
                rows = []
                with fs.open_input_file(f"{root}.records") as f:
                    if f.read(len(MAGIC)) != MAGIC:
                        raise ValueError(f"{path} is no token file")
                    width = f.read(1)[0]
                    for at, n in entries:
                        size = HEAD_SIZE + OWN_SIZE + n * width + 4
                        doc_id, ids = ids_of(payload_at(memoryview(f.read_at(size, at)), 0), width)
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.repartition(max(1, manifest.count()), F.col("shard")).mapInArrow(read, READ)


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_token_files(write_token_files(docs, shared_dir(spark)))
