"""Token-id files: fixed-size id blocks, transposed into byte or bit planes, each plane compressed with zstandard.

A block's payload is ``WGTP``, version 1, mode (0 byte planes, 1 bit planes), number of planes (u8 each), number of ids
(u32), the planes' compressed sizes (u32 each), then the planes.  All integers are little-endian.  Blocks and the index
of the documents' segments in them are rows of a Parquet dataset, so that Spark's committer, any file system it knows
and its recovery apply.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, text_or_empty, tokenizer_path
from .encode import encoder

VOCABULARY, END_ID = "byte_bpe_50k.json", 0
BLOCK_IDS = 1 << 16
MAGIC, BYTES, BITS = b"WGTP", 0, 1
HEADER = struct.Struct("<4sBBBxI")
SEGMENTS = pa.list_(pa.struct([("document", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("no", pa.int32()), ("last", pa.bool_())]))


def encode_block(ids: np.ndarray, mode: int = BYTES, level: int = 3) -> bytes:
    """The payload of one block of unsigned 32-bit ids."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if mode == BITS:
        planes = [np.packbits(p).tobytes() for p in np.unpackbits(raw, axis=1, bitorder="little").T]
    else:
        planes = [np.ascontiguousarray(p).tobytes() for p in raw.T]
    while planes and not any(planes[-1]):  # zero planes at the top aren't stored
        planes.pop()
    pack = zstandard.ZstdCompressor(level=level)
    packed = [pack.compress(p) for p in planes]
    return HEADER.pack(MAGIC, 1, mode, len(packed), len(raw)) + struct.pack(f"<{len(packed)}I", *map(len, packed)) + b"".join(packed)


def decode_block(payload: bytes) -> np.ndarray:
    magic, version, mode, planes, n = HEADER.unpack_from(payload)
    if magic != MAGIC or version != 1:
        raise ValueError("not a token block")
    sizes = struct.unpack_from(f"<{planes}I", payload, HEADER.size)
    at = HEADER.size + 4 * planes
    unpack = zstandard.ZstdDecompressor()
    if mode == BITS:
        bits = np.zeros((32, n), np.uint8)
        for k, size in enumerate(sizes):
            bits[k] = np.unpackbits(np.frombuffer(unpack.decompress(payload[at : at + size]), np.uint8), count=n)
            at += size
        return np.packbits(bits.T, axis=1, bitorder="little").reshape(-1).view("<u4").copy()
    raw = np.zeros((n, 4), np.uint8)
    for k, size in enumerate(sizes):
        raw[:, k] = np.frombuffer(unpack.decompress(payload[at : at + size]), np.uint8)
        at += size
    return raw.reshape(-1).view("<u4")


def crc32_combine(first: int, second: int, length: int) -> int:
    """crc32 of two byte strings one after the other from their own; ``length``: bytes of the second."""
    if not length:
        return first
    times = lambda m, v: _xor(m[i] for i in range(32) if v >> i & 1)
    odd = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
    even = [times(odd, v) for v in odd]
    odd = [times(even, v) for v in even]
    while length:
        even = [times(odd, v) for v in odd]
        if length & 1:
            first = times(even, first)
        length >>= 1
        odd, even = even, odd
    return first ^ second


def _xor(values) -> int:
    out = 0
    for v in values:
        out ^= v
    return out


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS, mode: int = BYTES) -> str:
    """Write the ids of all documents in ascending doc_id order below ``path``; returns ``path``.

    A null text counts as empty (the end id only); null ids come first; documents of equal id are ordered by a hash of
    their text, so repeated rows lie side by side; a text of any length is encoded whole and runs on over blocks; other
    columns aren't read; an empty table gives an empty dataset.
    """
    vocabulary = vocabulary or tokenizer_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(vocabulary), TaskContext.get().partitionId()
        held, held_n, block, done, document = [], 0, 0, 0, 0
        segments: list[dict] = []

        def flush() -> pa.RecordBatch:
            nonlocal held, held_n, block, done, segments
            payload = encode_block(np.concatenate(held), mode)
            row = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([done], pa.int64()), pa.array([held_n], pa.int32()), pa.array([payload], pa.binary()), pa.array([segments], SEGMENTS)]
            block, done = block + 1, done + held_n
            held, held_n, segments = [], 0, []
            return pa.RecordBatch.from_arrays(row, names=["shard", "block", "first_id", "n_ids", "payload", "segments"])

        for b in batches:
            ids, counts = enc.encode(b.column(1).to_pylist())
            ends = np.cumsum(counts)
            for doc_id, lo, hi in zip(b.column(0).to_pylist(), (ends - counts).tolist(), ends.tolist()):
                own = np.append(ids[lo:hi], np.uint32(end_id))
                at = no = 0
                while at < len(own):
                    part = own[at : at + block_ids - held_n]
                    at += len(part)
                    segments.append({"document": document, "doc_id": doc_id, "at": held_n, "n": len(part), "no": no, "last": at == len(own)})
                    held.append(part)
                    held_n += len(part)
                    no += 1
                    if held_n == block_ids:
                        yield flush()
                document += 1
        if held_n:
            yield flush()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = source.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.select("doc_id", "text").mapInArrow(run, "shard int, block int, first_id long, n_ids int, payload binary, segments array<struct<document:long,doc_id:long,at:int,n:int,no:int,last:boolean>>").write.option("compression", "none").option("parquet.block.size", str(16 << 20)).parquet(path)
    return path


def block_index(spark: SparkSession, path: str) -> DataFrame:
    """(shard, block, start, n_ids): the place of each block's first id among all ids."""
    blocks = spark.read.parquet(path).select("shard", "block", "first_id", "n_ids")
    return blocks.join(F.broadcast(_shard_starts(spark, path)), "shard").select("shard", "block", (F.col("shard_start") + F.col("first_id")).alias("start"), "n_ids")


def _shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """A row for each written partition: ids before it.  As many rows as writing tasks, whatever the data."""
    sums = spark.read.parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()
    rows, before = [], 0
    for shard, n in sorted((r["shard"], r["n"]) for r in sums):
        rows.append((shard, before))
        before += n
    return spark.createDataFrame(rows, "shard int, shard_start long")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, segment, ids array) of every segment of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for payload, segments in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = decode_block(payload).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s["doc_id"] for s in segments], pa.int64()), pa.array([s["no"] for s in segments], pa.int32()), pa.array([ids[s["at"] : s["at"] + s["n"]] for s in segments], pa.list_(pa.int64()))],
                    names=["doc_id", "segment", "ids"],
                )

    return spark.read.parquet(path).select("payload", "segments").mapInArrow(run, "doc_id long, segment int, ids array<long>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files."""
    names = ["shard", "document", "no", "doc_id", "start", "n", "crc", "last"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, first, payload, segments in zip(*(b.column(k).to_pylist() for k in range(4))):
                data = memoryview(decode_block(payload).astype("<u4", copy=False).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard] * len(segments), pa.int32()),
                        pa.array([s["document"] for s in segments], pa.int64()),
                        pa.array([s["no"] for s in segments], pa.int32()),
                        pa.array([s["doc_id"] for s in segments], pa.int64()),
                        pa.array([first + s["at"] for s in segments], pa.int64()),
                        pa.array([s["n"] for s in segments], pa.int64()),
                        pa.array([zlib.crc32(data[4 * s["at"] : 4 * (s["at"] + s["n"])]) for s in segments], pa.int64()),
                        pa.array([s["last"] for s in segments], pa.bool_()),
                    ],
                    names=names,
                )

    def join_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_row = None  # of a document whose last segment hasn't come: [doc_id, start, n, crc]
        for b in batches:
            out = []
            for no, doc_id, start, n, crc, last in zip(*(b.column(k).to_pylist() for k in range(2, 8))):
                row = [doc_id, start, n, crc] if no == 0 else [open_row[0], open_row[1], open_row[2] + n, crc32_combine(open_row[3], crc, 4 * n)]
                open_row = None if last else row
                if last:
                    out.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    blocks = spark.read.parquet(path).join(F.broadcast(_shard_starts(spark, path)), "shard")
    blocks = blocks.select("shard", (F.col("shard_start") + F.col("first_id")).alias("first"), "payload", "segments")
    segments = blocks.mapInArrow(digest, "shard int, document long, no int, doc_id long, start long, n long, crc long, last boolean")
    by_document = segments.repartition("shard", "document").sortWithinPartitions("shard", "document", "no")
    return by_document.mapInArrow(join_segments, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_through_files(docs: DataFrame, path: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): the token files of ``docs`` written, and each document's digest read back.

    Odd rows are treated as in ``write_token_files``; every row gives a row; crc32 of a document over several blocks is
    combined from those of its parts.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_token_files(docs, path, vocabulary)
    return read_digests(spark, path)
