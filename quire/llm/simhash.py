"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints are made in one pass over the texts.  Only distinct ones go on; copies meet in a grouping with partial
aggregation.  A fingerprint of 64 bits is split into blocks, two more than bits may differ; two fingerprints that link
have at least two blocks in common, so they meet under the key of some pair of blocks.  Under a key:

- up to `direct` fingerprints are compared pair by pair, by Hamming distance;
- more are not: each is put down at every value one bit away in its other blocks.  Two that meet at a value differ in
  at most two bits, and any two that do meet there, so this finds the same links in linear work;
- a key with over `task_limit` distinct fingerprints is not held in one task; that step is then done by a shuffle.

What leaves a task are not links but, for each fingerprint with one, the smallest that it reaches inside the task.
Components of the whole follow from those.

A null text is an empty one; a text without words has the fingerprint zero.  Repeated rows are rows of one component.  Texts of
any length are read whole.  Extra columns, whatever their names, are not read; keep_one
and drop_near_copies return them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quire.llm.blocks import byte_ranges, text_bytes
from quire.llm.graph import components, local_roots
from quire.llm.memory import lean
from quire.llm.near_copies import component_classes, keep_first, keep_rows
from quire.llm.shingles import SEED, slices
from quire.llm.storage import cut, partitions

_CHUNK_BYTES = 1 << 20


def fingerprints_of(body: np.ndarray, at: np.ndarray, width: int = 3) -> np.ndarray:
    """The fingerprint of each text: a bit is 1 if it is set in over half the shingles' hashes."""
    docs = len(at) - 1
    flat, a, b, owner = slices(body, at, width)
    if not len(owner):
        return np.zeros(docs, np.uint64)
    shingles = np.bincount(owner, minlength=docs)
    digest = xxhash.xxh64_intdigest
    total = np.zeros((docs, 64), np.int64)
    for lo in range(0, len(owner), 1 << 18):
        hi = min(len(owner), lo + (1 << 18))
        hashes = np.array([digest(flat[x:y], SEED) for x, y in zip(a[lo:hi].tolist(), b[lo:hi].tolist(), strict=True)], ">u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        edge = np.flatnonzero(np.concatenate([[True], owner[lo + 1 : hi] != owner[lo : hi - 1]]))
        total[owner[lo:hi][edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int32)
    set_bits = 2 * total > shingles[:, None]
    return np.packbits(set_bits, axis=1).view(">u8").ravel().astype(np.uint64)


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, at = text_bytes(batch.column(1))
            parts = [fingerprints_of(body[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], width) for lo, hi in byte_ranges(at, _CHUNK_BYTES)]
            prints = np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["doc_id", "print"])

    return run


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, print): the 64-bit fingerprint of each text as a signed long.  A text without words has 0, a null is an empty text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(_fingerprints(width)), "doc_id long, print long")


# --- links between distinct fingerprints --------------------------------------------------------------------------


def block_masks(distance: int) -> list[int]:
    """For distance + 2 blocks, the bits of each pair of them."""
    blocks = distance + 2
    edges = [64 * i // blocks for i in range(blocks + 1)]
    mask = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(blocks)]
    return [mask[i] | mask[j] for i, j in combinations(range(blocks), 2)]


def _links_direct(prints: np.ndarray, run_of: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of neighbouring rows with one key."""
    a, b = [], []
    for step in range(1, int(np.bincount(run_of).max())):
        same = np.flatnonzero(run_of[step:] == run_of[:-step])
        if not len(same):
            break
        near = same[np.bitwise_count(prints[same] ^ prints[same + step]) <= distance]
        a.append(prints[near])
        b.append(prints[near + step])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _flips(rest: int, bits: int) -> np.ndarray:
    """The masks with up to `bits` of the bits of rest."""
    places = [1 << i for i in range(64) if rest >> i & 1]
    return np.array([sum(c) for k in range(bits + 1) for c in combinations(places, k)], np.uint64)


def _links_by_value(prints: np.ndarray, rest: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """For an even distance: each fingerprint and the smallest that meets it at a value half the distance away."""
    flips = _flips(rest, distance // 2)
    values = (prints[:, None] ^ flips[None, :]).ravel()
    order = np.argsort(values, kind="stable")
    owner = np.repeat(prints, len(flips))[order]
    edge = np.flatnonzero(np.concatenate([[True], values[order][1:] != values[order][:-1]]))
    least = np.repeat(np.minimum.reduceat(owner, edge), np.diff(np.append(edge, len(owner))))
    other = owner != least
    return owner[other], least[other]


def _reach(masks: list[int], distance: int, direct: int, task_limit: int):
    """Rows of (which, key, print), ordered by key: kind 0 rows are (print, smallest reached), kind 1 rows are left for the shuffle."""

    def emit(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(a), kind), pa.int32()), "a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    def groups(which: np.ndarray, key: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.concatenate([[True], (which[1:] != which[:-1]) | (key[1:] != key[:-1])])
        run_of = np.cumsum(new) - 1
        size = np.bincount(run_of)
        small = size[run_of] <= direct
        a, b = _links_direct(prints[small], np.unique(run_of[small], return_inverse=True)[1], distance) if small.any() else (np.zeros(0, np.uint64),) * 2
        parts = [(a, b)]
        edges = np.concatenate([np.flatnonzero(new), [len(prints)]])
        for r in np.flatnonzero(size > direct).tolist():
            lo, hi = int(edges[r]), int(edges[r + 1])
            parts.append(_links_by_value(prints[lo:hi], ~masks[int(which[lo])] & (1 << 64) - 1, distance))
        a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        if len(a):
            nodes, roots = local_roots(a, b)
            other = nodes != roots
            yield emit(0, nodes[other], roots[other])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        which, key, prints = np.zeros(0, np.int64), none, none
        hot: tuple[int, int] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            which = np.concatenate([which, np.asarray(batch.column(0)).astype(np.int64)])
            key = np.concatenate([key, np.asarray(batch.column(1)).view(np.uint64)])
            prints = np.concatenate([prints, np.asarray(batch.column(2)).view(np.uint64)])
            if hot is not None:
                more = (which == hot[0]) & (key == hot[1])
                if more.any():
                    yield emit(1, prints[more], which[more].view(np.uint64))
                    which, key, prints = which[~more], key[~more], prints[~more]
            if not len(which):
                continue
            open_ = (which == which[-1]) & (key == key[-1])
            if not open_.all():
                yield from groups(which[~open_], key[~open_], prints[~open_])
                which, key, prints = which[open_], key[open_], prints[open_]
            if len(which) > task_limit:
                hot = int(which[0]), int(key[0])
                yield emit(1, prints, which.view(np.uint64))
                which, key, prints = which[:0], none, none
        if len(which):
            yield from groups(which, key, prints)

    return run


def link(prints: DataFrame, distance: int = 2, direct: int = 256, task_limit: int = 1 << 17) -> DataFrame:
    """prints: distinct fingerprints.  (a, b) rows whose components are those of all pairs at `distance` or fewer differing bits."""
    if distance % 2 or distance < 0:
        raise ValueError("distance is even")
    masks = block_masks(distance)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("which"), F.col("print").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(signed)])
    rows = prints.select("print", F.inline(keys)).select("which", "key", "print")
    dealt = rows.repartition(partitions(prints.sparkSession), "which", "key").sortWithinPartitions("which", "key", "print")
    found = cut(dealt.mapInArrow(lean(_reach(masks, distance, direct, task_limit)), "kind int, a long, b long"))
    near = found.where("kind = 0").select("a", "b")
    large = found.where("kind = 1")
    if large.isEmpty():
        return near
    # A value has at most as many fingerprints as there are flips, so these groups are small however large the key was.
    flips = F.create_map(*[x for i, m in enumerate(masks) for x in (F.lit(i), F.array(*[F.lit(int(f) - (1 << 64) if int(f) >> 63 else int(f)).cast("long") for f in _flips(~m & (1 << 64) - 1, distance // 2)]))])
    values = large.select(F.col("b").cast("int").alias("which"), "a", F.explode(F.element_at(flips, F.col("b").cast("int"))).alias("flip"))
    at_value = Window.partitionBy("which", F.col("a").bitwiseXOR(F.col("flip")))
    return near.unionByName(values.select("a", F.min("a").over(at_value).alias("b")).where("a <> b"))


def near_duplicates(docs: DataFrame, distance: int = 2, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs; component_id is the smallest doc_id that it reaches over links
    of `distance` or fewer differing bits.  A row without doc_id takes part; a component of only such rows has no id."""
    prints = cut(simhash(docs, id_col, text_col, width))
    classes = cut(prints.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(link(classes.select("print"), distance))
    rooted = classes.join(roots, classes["print"] == roots["node"], "left").select("print", "least", "n", F.coalesce("root", "print").alias("root"))
    linked = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    table = cut(rooted.join(linked, "root").select("print", "n", "component_id"))
    # Fingerprints of over a thousandth of all rows are fewer than a thousand: those are broadcast, so no join key is hot.
    total = prints.count()
    often = F.col("n") > max(64, total // 1000)
    hot = table.where(often).select("print", F.col("component_id").alias("hot_id"), F.lit(True).alias("is_hot"))
    marked = prints.join(F.broadcast(hot), "print", "left")
    name = F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint")
    first = marked.where("is_hot").select("doc_id", name, F.col("hot_id").alias("component_id"))
    rest = marked.where("is_hot is null").select("doc_id", "print").join(table.where(~often).select("print", "component_id"), "print")
    return first.unionByName(rest.select("doc_id", name, "component_id"))


def _marked(column: int, width: int):
    fingerprints = _fingerprints(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(column)
            for own in fingerprints(iter([pa.RecordBatch.from_arrays([text, text], ["doc_id", "text"])])):
                yield batch.append_column("__print", own.column(1))

    return run


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """docs with one row of each component of found (near_duplicates of docs with that width): the one of the smallest doc_id and, of
    several fingerprints with that id, the smallest.  Rows without doc_id stay; of rows that share id and fingerprint one stays,
    the same one however docs are partitioned."""
    kept = found.where("doc_id is not null").groupBy("component_id").agg(F.min(F.struct("doc_id", "fingerprint")).alias("k")).select(F.col("k.doc_id").alias("__id"), F.col("k.fingerprint").alias("__kept"))
    schema = StructType([*docs.schema.fields, StructField("__print", LongType())])
    rows = docs.where(F.col(id_col).isNotNull()).mapInArrow(lean(_marked(docs.columns.index(text_col), width)), schema)
    named = rows.withColumn("__name", F.lower(F.lpad(F.hex("__print"), 16, "0"))).drop("__print")
    known = keep_rows(named, kept, id_col, "__name", docs.columns)
    return known.unionByName(docs.where(F.col(id_col).isNull()))


def drop_near_copies(docs: DataFrame, width: int = 5, tenths: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near-duplicates: of each component of texts whose shingles of `width` words have a Jaccard similarity of tenths / 10 or
    more, one row with the smallest doc_id (of several texts with that id, the one of the smallest digest) stays as it is.

    A fingerprint alone doesn't decide this: texts at a similarity of 0.8 differ in some 10 +- 3 of 64 bits.  So candidates come from the bands of
    several fingerprints and their Hamming distance, and whole
    sets of shingles are compared (near_copies.py).  Repeated rows are one row.  Rows without doc_id take part, and stay."""
    return keep_first(docs, component_classes(docs, width, tenths, id_col, text_col), id_col, text_col)
