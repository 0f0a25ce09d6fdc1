"""Token ids in binary files of fixed bit width.

A file is a row of segments.  A segment holds whole documents in order:

    header    64 bytes: magic, bits per id, ids per block, documents, ids, part, number in the part, length in bytes
    known     one byte a document: 0 where the row had no id
    doc ids   int64 a document
    ends      uint64 a document: ids up to and with it
    blocks    uint64 a block and one more: where each block starts, in bytes from the first
    ids       blocks of a fixed number of ids, each id in the fewest bits that the vocabulary needs, a block at a byte's edge
    newline   one byte

All numbers are little-endian.  Any id is found without reading what stands before it: its block's offset is in the
table, its bits are at a fixed place in the block, and numpy unpacks a whole block at once.

The files are written by Spark's own writer to the shared folder, one for each partition of a range partitioning by
id, so their order is the order of the ids.  A segment is bounded (`segment_ids`), so is the memory to write one, and files
are as many as their size wants (FILE_BYTES of text each).  Rows without an id, or with one that many share, are told apart by
the start of their text and by where they were read, so they are dealt to many files like any others.

A null text is an empty one.  Repeated rows are documents of their own.  Texts of any length are one document.  Other
columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.memory import lean
from quire.llm.storage import cut, fresh_path, partitions
from quire.llm.tokens import encoder, tokenizer_path, with_end

MAGIC = b"QUIRETK1"
BLOCK_IDS = 1 << 16
SEGMENT_IDS = 1 << 22
#: Offsets of so many segments at most (24 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_SEGMENTS = 100_000
#: Text that goes to one file, about.
FILE_BYTES = 256 << 20
_HEAD = struct.Struct("<8sIIQQIIQ16x")


def width_of(vocabulary: int) -> int:
    """The fewest bits that tell all ids of a vocabulary apart."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def unpack_ids(raw: bytes | memoryview, count: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(raw, f"<u{width // 8}", count).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little", count=count * width).reshape(count, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def segment_bytes(doc_ids: np.ndarray, known: np.ndarray, lens: np.ndarray, ids: np.ndarray, width: int, part: int, number: int) -> bytes:
    blocks = [pack_ids(ids[i : i + BLOCK_IDS], width) for i in range(0, len(ids), BLOCK_IDS)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    tables = known.astype(np.uint8).tobytes() + doc_ids.astype("<i8").tobytes() + np.cumsum(lens).astype("<u8").tobytes() + offsets.tobytes()
    size = _HEAD.size + len(tables) + int(offsets[-1])
    return b"".join([_HEAD.pack(MAGIC, width, BLOCK_IDS, len(lens), len(ids), part, number, size), tables, *blocks])


class Segment:
    """A segment in memory; nothing is unpacked until asked for."""

    def __init__(self, raw: bytes | memoryview, at: int = 0) -> None:
        magic, self.width, self.block_ids, self.n_docs, self.n_ids, self.part, self.number, self.size = _HEAD.unpack_from(raw, at)
        if magic != MAGIC:
            raise ValueError("not a segment of token ids")
        self.raw = memoryview(raw)[at : at + self.size]
        p, n, blocks = _HEAD.size, self.n_docs, -(-self.n_ids // self.block_ids)
        self.known = np.frombuffer(self.raw, np.uint8, n, p).astype(bool)
        self.doc_ids = np.frombuffer(self.raw, "<i8", n, p + n)
        self.ends = np.frombuffer(self.raw, "<u8", n, p + 9 * n).astype(np.int64)
        self.offsets = np.frombuffer(self.raw, "<u8", blocks + 1, p + 17 * n).astype(np.int64)
        self.data = p + 17 * n + 8 * (blocks + 1)

    def block(self, k: int) -> np.ndarray:
        count = min(self.block_ids, self.n_ids - k * self.block_ids)
        return unpack_ids(self.raw[self.data + self.offsets[k] : self.data + self.offsets[k + 1]], count, self.width)

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop of the segment; only the blocks that hold them are unpacked."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        got = np.concatenate([self.block(k) for k in range(first, last + 1)])
        return got[start - first * self.block_ids : stop - first * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def segments(raw: bytes) -> Iterator[Segment]:
    at = 0
    while at + _HEAD.size <= len(raw):
        segment = Segment(raw, at)
        yield segment
        at += segment.size + 1


def _write(name: str, end_id: int | None, width: int, segment_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = encoder(tokenizer_path(name)), TaskContext.get().partitionId()
        held: list[tuple] = []
        total = number = 0

        def flush() -> pa.RecordBatch:
            docs, known, lens, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_pydict({"segment": pa.array([segment_bytes(docs, known, lens, ids, width, part, number)], pa.binary())})

        for batch in batches:
            step = 256
            for lo in range(0, batch.num_rows, step):
                some = batch.slice(lo, step)
                ids, at = code.column(some.column(1))
                if end_id is not None:
                    ids, at = with_end(ids, at, end_id)
                if len(ids) and int(ids.max()) >> width:
                    raise ValueError(f"id {ids.max()} needs more than {width} bits")
                key = some.column(0)
                held.append((np.asarray(key.fill_null(0)).astype(np.int64), np.asarray(key.is_valid()), np.diff(at), ids))
                total += len(ids)
                if total >= segment_ids:
                    yield flush()
                    held, total, number = [], 0, number + 1
        if held:
            yield flush()

    return run


def write_token_files(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int | None, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = SEGMENT_IDS) -> str:
    """Encode docs in ascending order of id (rows without one first, ties by the start of the text) and write token files; returns the folder."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    width = width_of(max(vocabulary, (end_id or 0) + 1))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    files = max(partitions(spark), -(-size // FILE_BYTES))
    spread = own.select("id", "text", F.substring("text", 1, 32).alias("start"), F.monotonically_increasing_id().alias("read"))
    ordered = spread.repartitionByRange(files, "id", "start", "read").sortWithinPartitions("id", "text").select("id", "text")
    rows = ordered.mapInArrow(lean(_write(tokenizer, end_id, width, segment_ids)), "segment binary")
    # The text writer puts a string's bytes down as they are, and a line's end after them.
    rows.select(F.col("segment").cast("string")).write.text(path)
    return path


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0):
            found = [(s.part, s.number, s.n_ids) for s in segments(raw.as_py())]
            yield pa.RecordBatch.from_pydict({n: pa.array([x[i] for x in found], pa.int64()) for i, n in enumerate(("part", "number", "n_ids"))})


def _documents(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                for s in segments(raw.as_py()):
                    starts = np.concatenate([[0], s.ends])[:-1].astype(np.int64)
                    ids = s.ids().astype("<u4")
                    data = memoryview(ids.view(np.uint8))
                    crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), s.ends.tolist(), strict=True)]
                    out = {
                        "part": pa.array(np.full(s.n_docs, s.part), pa.int64()),
                        "number": pa.array(np.full(s.n_docs, s.number), pa.int64()),
                        "doc_id": pa.array(s.doc_ids, pa.int64(), mask=~s.known),
                        "local": pa.array(starts, pa.int64()),
                        "n_tokens": pa.array(s.ends - starts, pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                    if with_ids:
                        out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(starts, s.n_ids), pa.int32()), pa.array(ids.astype(np.int32), pa.int32()))
                    yield pa.RecordBatch.from_pydict(out)

    return run


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """A row for each document in the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and its ids if asked for."""
    heads = _files(spark, path).mapInArrow(_heads, "part long, number long, n_ids long")
    in_part = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    by_part = heads.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    # One row a file: the only scan over all of them.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("part", F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("base"))
    offsets = heads.select("part", "number", F.coalesce(F.sum("n_ids").over(in_part), F.lit(0)).alias("inner")).join(bases, "part")
    schema = "part long, number long, doc_id long, local long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    rows = _files(spark, path).mapInArrow(lean(_documents(with_ids)), schema)
    start = (F.col("base") + F.col("inner") + F.col("local")).alias("start")
    offsets = cut(offsets)
    if offsets.count() <= BROADCAST_SEGMENTS:
        offsets = F.broadcast(offsets)
    return rows.join(offsets, ["part", "number"]).select("doc_id", start, "n_tokens", "ids_crc32", *["ids"] * with_ids)
