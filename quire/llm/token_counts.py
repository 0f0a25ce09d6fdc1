"""Token counts by a separator scan of flat token files.

A flat file is nothing but 16-bit little-endian ids, one more than the tokenizer's, with 0 at the end of each document.  It has no
index: documents are found by looking for zeros.  A block of a file is searched with numpy at once, and says how many ids
and separators it has and where those are.  A prefix scan over the blocks of a file, and one over the files (a row
each), give every block the ids before it and the last separator before it, so that a document over any number of
blocks or files is counted whole.

With tags a document's ids are followed by its doc_id in five words of 13 bits (each plus one, so never 0); files
without tags give ordinals only.  Ids after the last separator of all files are a document without an end and are not counted.

The files are written where the documents are read, one for each partition: the texts are not shuffled.

A null or empty text is a document of the end identifier alone.  Repeated rows, and rows that share a doc_id, are documents of
their own; a row without doc_id is one whose tag says so.  Texts of any length are one document.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.storage import cut, fresh_path
from quire.llm.tokens import encoder, tokenizer_path

BLOCK_IDS = 1 << 20
TAG_WORDS, _TAG_BITS = 5, 13
_NO_ID = (1 << _TAG_BITS) + 1


def tags_of(ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    shifts = np.arange(TAG_WORDS, dtype=np.uint64) * np.uint64(_TAG_BITS)
    words = (ids.astype(np.int64).view(np.uint64)[:, None] >> shifts & np.uint64((1 << _TAG_BITS) - 1)) + np.uint64(1)
    words[~known] = _NO_ID
    return words.astype("<u2")


def ids_of(tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    shifts = np.arange(TAG_WORDS, dtype=np.uint64) * np.uint64(_TAG_BITS)
    known = tags[:, 0] != _NO_ID
    return (((tags.astype(np.uint64) - np.uint64(1)) & np.uint64((1 << _TAG_BITS) - 1)) << shifts).sum(axis=1, dtype=np.uint64).view(np.int64), known


def _encode(tokenizer: str, tagged: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer_path(tokenizer))
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                some = batch.slice(lo, 1024)
                ids, at = code.column(some.column(1))
                if len(ids) and ids.max() >= 0xFFFF:
                    raise ValueError(f"id {ids.max()} doesn't fit into 16 bits")
                flat = memoryview((ids + np.uint32(1)).astype("<u2").view(np.uint8))
                key = some.column(0)
                tags = tags_of(np.asarray(key.fill_null(0)), np.asarray(key.is_valid())) if tagged else None
                rows = [bytes(flat[2 * a : 2 * b]) + (tags[k].tobytes() if tagged else b"") for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))]
                yield pa.RecordBatch.from_pydict({"ids": pa.array(rows, pa.binary())})

    return run


def write_flat_files(docs: DataFrame, tokenizer: str, path: str | None = None, tagged: bool = True, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write docs to flat token files, a file for each partition in its order; returns the folder."""
    path = path or fresh_path(docs.sparkSession, "flat")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_encode(tokenizer, tagged), "ids binary")
    rows.select(F.col("ids").cast("string")).write.option("lineSep", "\0\0").text(path)
    return path


def _scan(block_ids: int, tagged: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = content.as_buffer()
                ids = np.frombuffer(raw, "<u2", raw.size // 2)
                rows: dict[str, list] = {n: [] for n in ("file", "number", "n_ids", "n_ends", "last_end", "ends", "ids", "known")}
                for number, lo in enumerate(range(0, len(ids), block_ids)):
                    block = ids[lo : lo + block_ids]
                    ends = np.flatnonzero(block == 0)
                    owner, known = np.zeros(len(ends), np.int64), np.zeros(len(ends), bool)
                    if tagged and len(ends):
                        owner, known = ids_of(ids[(ends + lo)[:, None] + np.arange(-TAG_WORDS, 0)])
                    for name, value in zip(rows, (path, number, len(block), len(ends), int(ends[-1]) if len(ends) else None, ends.astype("<i8").tobytes(), owner.tobytes(), known.tobytes()), strict=True):
                        rows[name].append(value)
                yield pa.RecordBatch.from_arrays([pa.array(rows["file"], pa.string()), *(pa.array(rows[n], pa.int64()) for n in ("number", "n_ids", "n_ends", "last_end")), *(pa.array(rows[n], pa.binary()) for n in ("ends", "ids", "known"))], list(rows))

    return run


def _documents(tagged: bool):
    extra = TAG_WORDS if tagged else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.frombuffer(row["ends"], "<i8") + row["ids_before"]
                starts = np.concatenate([[row["end_before"] + 1], ends[:-1] + 1])
                ordinal = row["docs_before"] + np.arange(len(ends))
                known = np.frombuffer(row["known"], bool)
                # Positions in the documents' own ids: without the separators and tags before.
                out = {
                    "ordinal": pa.array(ordinal, pa.int64()),
                    "doc_id": pa.array(np.frombuffer(row["ids"], np.int64), pa.int64(), mask=~known),
                    "start": pa.array(starts - ordinal * (1 + extra), pa.int64()),
                    "n_tokens": pa.array(ends - starts - extra, pa.int64()),
                }
                yield pa.RecordBatch.from_pydict(out)

    return run


def count_tokens(spark: SparkSession, path: str, tagged: bool = True, block_ids: int = BLOCK_IDS) -> DataFrame:
    """ordinal, doc_id, start (tokens of all documents before it) and n_tokens of each document in the flat files of a folder, in the
    files' order by name.  An empty text is a document of no tokens."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    schema = "file string, number long, n_ids long, n_ends long, last_end long, ends binary, ids binary, known binary"
    blocks = cut(files.mapInArrow(_scan(block_ids, tagged), schema))
    in_file = Window.partitionBy("file").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.select("*", F.coalesce(F.sum("n_ids").over(in_file), F.lit(0)).alias("ids_in"), F.coalesce(F.sum("n_ends").over(in_file), F.lit(0)).alias("docs_in"))
    placed = placed.withColumn("end_in", F.max(F.col("ids_in") + F.col("last_end")).over(in_file))
    totals = placed.groupBy("file").agg(F.sum("n_ids").alias("f_ids"), F.sum("n_ends").alias("f_docs"), F.max(F.col("ids_in") + F.col("last_end")).alias("f_end"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    sums = totals.select("file", F.coalesce(F.sum("f_ids").over(before), F.lit(0)).alias("f_ids_before"), F.coalesce(F.sum("f_docs").over(before), F.lit(0)).alias("f_docs_before"), "f_end")
    bases = sums.withColumn("f_end_before", F.coalesce(F.max(F.col("f_ids_before") + F.col("f_end")).over(before), F.lit(-1)))
    joined = placed.where("n_ends > 0").join(bases, "file")
    rows = joined.select(
        (F.col("f_ids_before") + F.col("ids_in")).alias("ids_before"),
        (F.col("f_docs_before") + F.col("docs_in")).alias("docs_before"),
        F.coalesce(F.col("f_ids_before") + F.col("end_in"), F.col("f_end_before")).alias("end_before"),
        "ends",
        "ids",
        "known",
    )
    return rows.mapInArrow(_documents(tagged), "ordinal long, doc_id long, start long, n_tokens long")
