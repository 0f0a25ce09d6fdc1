"""Documents in blocks of a few megabytes, stored bucketed by block.

Operators that work in passes send small digests out of each block and get answers back for it.  The block table is
written once, without a shuffle, bucketed by block id; a pass then co-groups it with its answers and only the answers
move.  The text itself never crosses the network.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.storage import fresh_path, partitions

BLOCK_BYTES = 4 << 20
BLOCK_SCHEMA = "block long, size long, words long, ids binary, known binary, lens binary, body binary"
#: Text that a bucket of digests answers for, about.
BUCKET_BYTES = 16 << 20


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, null as empty, and where each value starts (one more than values)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def byte_ranges(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of values of about limit bytes; a longer value is a run of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


@dataclass
class Block:
    block: int
    ids: np.ndarray  # int64; where known is false the value means nothing
    known: np.ndarray
    offsets: np.ndarray
    body: np.ndarray

    @staticmethod
    def of(table: pa.Table | pa.RecordBatch, row: int = 0) -> Block:
        get = lambda name: table.column(name)[row].as_py()
        lens = np.frombuffer(get("lens"), np.int64)
        return Block(
            get("block"),
            np.frombuffer(get("ids"), np.int64),
            np.frombuffer(get("known"), np.bool_),
            np.concatenate([[0], np.cumsum(lens)]).astype(np.int64),
            np.frombuffer(get("body"), np.uint8),
        )


def spark_hash(value: int, seed: int = 42) -> int:
    """Spark's hash of a long, by which it deals buckets: Murmur3 of 32 bits over its two halves."""
    mask = 0xFFFFFFFF
    turn = lambda x, n: (x << n | x >> 32 - n) & mask
    h = seed
    for half in (value & mask, value >> 32 & mask):
        h ^= turn(half * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
        h = (turn(h, 13) * 5 + 0xE6546B64) & mask
    h ^= 8
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * factor & mask
    return h - (1 << 32) if h >> 31 else h


def block_id(part: int, seq: int, buckets: int) -> int:
    """An id of its own for a task's block, so chosen that a task's blocks are dealt to one bucket after the other."""
    wanted = (part + seq) % buckets
    own = (part << 36) + (seq << 20)
    return next(own + k for k in range(1 << 20) if spark_hash(own + k) % buckets == wanted)


def _pack(limit: int, buckets: int, count_words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        known: list[np.ndarray] = []
        lens: list[np.ndarray] = []
        body: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            data, sizes = np.concatenate(body), np.concatenate(lens)
            at = np.concatenate([[0], np.cumsum(sizes)])
            row = {
                "block": pa.array([block_id(part, seq, buckets)], pa.int64()),
                "size": pa.array([held], pa.int64()),
                "words": pa.array([count_words(data, at) if count_words else 0], pa.int64()),
                "ids": pa.array([np.concatenate(ids).tobytes()], pa.binary()),
                "known": pa.array([np.concatenate(known).tobytes()], pa.binary()),
                "lens": pa.array([sizes.tobytes()], pa.binary()),
                "body": pa.array([data.tobytes()], pa.binary()),
            }
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            data, at = text_bytes(batch.column(1))
            key = batch.column(0)
            ok = np.asarray(key.is_valid())
            num = np.asarray(key.fill_null(0)).astype(np.int64)
            for lo, hi in byte_ranges(at, limit):
                ids.append(num[lo:hi])
                known.append(ok[lo:hi])
                lens.append(np.diff(at[lo : hi + 1]))
                body.append(data[at[lo] : at[hi]])
                held += int(at[hi] - at[lo])
                if held >= limit // 2:
                    yield flush()
                    seq += 1
                    ids, known, lens, body, held = [], [], [], [], 0
        if ids:
            yield flush()

    return run


def block_table(docs: DataFrame, id_col: str, text_col: str, label: str, block_bytes: int = BLOCK_BYTES, count_words=None) -> DataFrame:
    """docs as a table of blocks (BLOCK_SCHEMA) in the shared folder, bucketed by block.  count_words(bytes, starts), if given, counts a block's words."""
    spark = docs.sparkSession
    path = fresh_path(spark, label)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    blocks = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_pack(block_bytes, partitions(spark), count_words), BLOCK_SCHEMA)
    blocks.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(partitions(spark), "block").saveAsTable(name)
    table = spark.table(name)
    # The files stay, and what was read of the table knows its buckets; the catalogue needn't keep an entry for ever.
    spark.sql(f"DROP TABLE {name}")
    return table


def digest_buckets(table: DataFrame) -> tuple[int, int]:
    """(buckets for the digests of a block table, its words): buckets grow with the text, so what one holds doesn't."""
    row = table.agg(F.sum("size").alias("size"), F.sum("words").alias("words")).collect()[0]
    return max(4 * partitions(table.sparkSession), -(-(row["size"] or 0) // BUCKET_BYTES)), row["words"] or 0


# --- 64-bit digests over byte arrays -------------------------------------------------------------------------------

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x ^= x >> np.uint64(27)
    x *= _M3
    x ^= x >> np.uint64(31)
    return x


def words64(body: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as one big-endian word, so that words order as the bytes do; the end is padded with zeros."""
    b = np.concatenate([body, np.zeros(7, np.uint8)]).astype(np.uint64)
    x = (b[:-1] << np.uint64(8)) | b[1:]
    x = (x[:-2] << np.uint64(16)) | x[2:]
    return (x[:-4] << np.uint64(32)) | x[4:]


def buckets_of(digits: np.ndarray, count: int) -> np.ndarray:
    return ((mix(digits * _M1) >> np.uint64(33)) % np.uint64(count)).astype(np.int32)
