"""Approximate nearest neighbours by cosine: inverted lists with an adaptive dimension scan.

Vectors of one value are one vector with the few smallest ids that a result could name.  There are about as many lists as the root of the
number of vectors (one for `exact_rows` vectors or fewer, where lists would hold less than a query asks of them); their centroids are fitted on a hash sample of at most `sample_rows` vectors (sixteen a
list, so lists stop at a sixteenth of it).  Every vector goes to its nearest list, and a query probes the lists of its
nearest centroids, as many as the sample needed for its own neighbours (`aim`), and more until they hold enough vectors.

In a list, vectors and queries are rotated by one random rotation, so that any few coordinates estimate the whole
distance.  Coordinates are scanned in column blocks; after each, a candidate is abandoned if its partial distance,
scaled up, rejects at a fixed significance that it is nearer than the worst of the best found so far.  Candidates that
survive all blocks are scored exactly, in double precision on the original vectors.

Lists are cut into cells of bounded size on both sides, so neither a large list nor many queries meet in one task; a vector is sent once
unless over CELL_QUERIES queries probe its list.

Vectors that are null, zero, or hold null or non-finite components take no part; nor do rows without vec_id.  Vectors of different
lengths have no cosine: each length is searched among its own.  Components keep the precision of their column.  Repeated
rows of one vec_id and vector count once.  Other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from quire.llm.storage import cut

SAMPLE_ROWS = 65_536
EXACT_ROWS = 400
CELL_VECTORS, CELL_QUERIES = 8_192, 32_768
_ROWS = 1_024


def matrix(column: pa.Array, dims: int, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column that are whole vectors of so many finite components and not zero: which, and their values."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    lens = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    which = np.flatnonzero(lens == dims)
    if not len(which) or not dims:
        return np.zeros(0, np.int64), np.zeros((0, dims), kind)
    flat = column.take(pa.array(which)).flatten()
    values = np.asarray(flat.cast(pa.from_numpy_dtype(kind)).fill_null(float("nan"))).reshape(-1, dims)
    good = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)
    return which[good], values[good]


def unit(values: np.ndarray) -> np.ndarray:
    wide = values.astype(np.float64)
    wide = np.ldexp(wide, -np.frexp(np.abs(wide).max(axis=1, keepdims=True, initial=0))[1])  # by powers of two, so that no square is out of range
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


@dataclass
class Index:
    dims: int
    rotation: np.ndarray
    centroids: np.ndarray  # unit vectors, not rotated
    probes: int

    def lists(self, values: np.ndarray) -> np.ndarray:
        """The lists of each vector's centroids, nearest first."""
        return np.argsort(-(unit(values) @ self.centroids.T), axis=1, kind="stable")

    def nearest(self, values: np.ndarray) -> np.ndarray:
        return np.argmax(unit(values) @ self.centroids.T, axis=1)


def _pieces(rows: int) -> Iterator[slice]:
    return (slice(lo, lo + _ROWS) for lo in range(0, rows, _ROWS))


def _nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(points[s] @ centroids.T, axis=1) for s in _pieces(len(points))])


def fit_index(sample: np.ndarray, total: int, k: int = 6, aim: float = 0.98, exact_rows: int = EXACT_ROWS, seed: int = 11) -> Index:
    """Lists and probes for `total` vectors, from a sample of them."""
    dims = sample.shape[1]
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    points = unit(sample)
    count = 1 if total <= exact_rows else min(int(np.sqrt(total)), len(points) // 16)
    if count < 2:
        return Index(dims, rotation, points[:1], 1)
    centroids = points[rng.choice(len(points), count, replace=False)]
    for _ in range(8):
        own = _nearest(points, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, points)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centroids = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centroids)
    own = _nearest(points, centroids)
    # How far down a query's lists its neighbours lie, on queries of the sample.
    some = rng.choice(len(points), min(512, len(points)), replace=False)
    most = min(k, len(points))
    near = np.concatenate([np.argpartition(-(points[some[i : i + 32]] @ points.T), most - 1, axis=1)[:, :most] for i in range(0, len(some), 32)])
    place = np.argsort(np.argsort(-(points[some] @ centroids.T), axis=1), axis=1)
    depth = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    probes = int(depth[min(len(depth) - 1, int(np.ceil(aim * len(depth))))]) + 1
    return Index(dims, rotation, centroids, min(count, probes))


def adaptive_scan(vectors: np.ndarray, rotated: np.ndarray, query: np.ndarray, rotated_query: np.ndarray, k: int, block: int, strictness: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices and cosines of about the k nearest of vectors (unit, with their rotations) to a query."""
    dims = len(query)
    kept, cosines, bound = np.zeros(0, np.int64), np.zeros(0), np.inf
    for lo in range(0, len(vectors), 1_024):
        alive = np.arange(lo, min(len(vectors), lo + 1_024))
        partial = np.zeros(len(alive))
        for at in range(0, dims, block):
            gap = rotated[alive, at : at + block] - rotated_query[at : at + block]
            partial = partial + np.einsum("ij,ij->i", gap, gap)
            seen = min(dims, at + block)
            if np.isfinite(bound):
                limit = bound * (1 + strictness / np.sqrt(seen)) ** 2 * seen / dims if seen < dims else bound * (1 + 1e-5) + 1e-9
                stay = partial <= limit
                alive, partial = alive[stay], partial[stay]
                if not len(alive):
                    break
        if len(alive):
            kept = np.concatenate([kept, alive])
            cosines = np.concatenate([cosines, vectors[alive] @ query])
            if len(kept) > k:
                best = np.argpartition(-cosines, k - 1)[:k]
                worst = cosines[best].min()
                stay = cosines >= worst
                kept, cosines = kept[stay], cosines[stay]
                bound = max(0.0, 2 - 2 * worst)
    return kept, cosines


def _distinct(dims: int, k: int, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, values = matrix(batch.column(1), dims, kind)
            ids = np.asarray(batch.column(0).fill_null(0))[which]
            known = np.asarray(batch.column(0).is_valid())[which]
            of: dict[bytes, set[int]] = {}
            for key, i in zip([v.tobytes() for v in values[known]], ids[known].tolist(), strict=True):
                own = of.setdefault(key, set())
                own.add(i)
                if len(own) > 4 * k:
                    of[key] = set(sorted(own)[:k])
            yield pa.RecordBatch.from_pydict({"vector": pa.array(list(of), pa.binary()), "ids": pa.array([sorted(s)[:k] for s in of.values()], pa.list_(pa.int64()))})

    return run


def _queries(dims: int, every: int, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, values = matrix(batch.column(1), dims, kind)
            ids = np.asarray(batch.column(0).fill_null(1))[which]
            hit = np.flatnonzero((ids % every == 0) & np.asarray(batch.column(0).is_valid())[which])
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(ids[hit], pa.int64()), "vector": pa.array([values[i].tobytes() for i in hit], pa.binary())})

    return run


def _vectors(column, dims: int) -> np.ndarray:
    """Vectors from their bytes, in the precision that their length tells."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float32 if raw and len(raw[0]) == 4 * dims else np.float64).reshape(-1, dims)


def _assign(index, probe_need: int = 0, sizes: list[int] | None = None):
    """Rows get their list; with the lists' sizes, queries get every list that they probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = index.value
        for batch in (b.slice(s.start, _ROWS) for b in batches for s in _pieces(b.num_rows)):
            values = _vectors(batch.column("vector"), ix.dims)
            rows, lists = [], []
            if sizes is None:
                rows, lists = list(range(len(values))), ix.nearest(values).tolist()
            else:
                for r, order in enumerate(ix.lists(values).tolist()):
                    held = 0
                    for n, one in enumerate(order):
                        if n >= ix.probes and held >= probe_need:
                            break
                        if sizes[one]:
                            rows.append(r)
                            lists.append(one)
                            held += sizes[one]
            out = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), *out.columns], ["list", *out.schema.names])

    return run


def _search(index, k: int, block: int, strictness: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ix: Index = index.value
        queries, nodes, scores = [], [], []
        if left.num_rows and right.num_rows:
            vectors = unit(_vectors(left.column("vector"), ix.dims))
            asked = unit(_vectors(right.column("vector"), ix.dims))
            turned, turned_asked = vectors @ ix.rotation, asked @ ix.rotation
            names, ids = np.asarray(left.column("node")), right.column("query").to_pylist()
            for q, name in enumerate(ids):
                found, cosines = adaptive_scan(vectors, turned, asked[q], turned_asked[q], k, block, strictness)
                order = np.lexsort((names[found], -cosines))[:k]
                queries += [name] * len(order)
                nodes += names[found][order].tolist()
                scores += cosines[order].tolist()
        return pa.table({"query": pa.array(queries, pa.int64()), "node": pa.array(nodes, pa.int64()), "score": pa.array(scores, pa.float64())})

    return run


def nearest_neighbours(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = SAMPLE_ROWS, aim: float = 0.98, block: int = 16, strictness: float = 2.1, exact_rows: int = EXACT_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, its k nearest other rows that were found,
    nearest first, ties to the smaller id.  score is the cosine in double precision."""
    narrow = isinstance(vectors.schema[vector_col].dataType.elementType, FloatType)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if narrow else "array<double>").alias("v"))
    lengths = sorted(r["d"] for r in rows.where("size(v) > 0").select(F.size("v").alias("d")).distinct().collect())  # one search each
    found = [_search_length(rows.where(F.size("v") == d) if len(lengths) > 1 else rows, d, np.float32 if narrow else np.float64, k, every, sample_rows, aim, block, strictness, exact_rows) for d in lengths]
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double") if not found else found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _search_length(rows: DataFrame, dims: int, kind: type, k: int, every: int, sample_rows: int, aim: float, block: int, strictness: float, exact_rows: int) -> DataFrame:
    spark = rows.sparkSession
    want = k + 1  # a query's own row may be among them
    parts = rows.mapInArrow(_distinct(dims, want, kind), "vector binary, ids array<long>")
    least = lambda: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, want).alias("ids")
    # In two steps: a vector that very many rows share is gathered in shares first.
    merged = parts.groupBy("vector", (F.spark_partition_id() % 64).alias("share")).agg(least()).groupBy("vector").agg(least())
    distinct = cut(merged.select(F.col("ids")[0].alias("node"), "vector", "ids"))
    total = distinct.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share = min(1.0, sample_rows / total)
    sample = distinct.where(F.pmod(F.xxhash64("vector"), F.lit(1 << 20)) < int((1 << 20) * share) + 1).select("node", "vector").orderBy("node").limit(sample_rows).toArrow()
    if not sample.num_rows:
        sample = distinct.select("node", "vector").limit(1).toArrow()
    index = spark.sparkContext.broadcast(fit_index(_vectors(sample.column("vector"), dims), total, want, aim, exact_rows))
    listed = cut(distinct.mapInArrow(_assign(index), "list int, node long, vector binary, ids array<long>"))
    lists = len(index.value.centroids)
    sizes = [0] * lists
    for r in listed.groupBy("list").count().collect():  # at most sample_rows / 16 rows
        sizes[r["list"]] = r["count"]
    asked = rows.mapInArrow(_queries(dims, every, kind), "query_id long, vector binary")
    nodes = distinct.select("node", "vector")
    named = cut(asked.join(nodes, "vector").select("query_id", F.col("node").alias("query")))
    queries = named.select("query").distinct().join(nodes, F.col("query") == F.col("node")).select("query", "vector")
    probing = cut(queries.mapInArrow(_assign(index, 4 * want, sizes), "list int, query long, vector binary"))
    asks = {r["list"]: r["count"] for r in probing.groupBy("list").count().collect()}

    def cells(limit: int, counts: dict[int, int]):
        return F.element_at(F.from_json(F.lit(json.dumps([max(1, -(-counts.get(i, 0) // limit)) for i in range(lists)])), "array<int>"), F.col("list") + 1)

    # A cell is a share of a list's vectors with a share of the queries that probe it.
    rows_cells, ask_cells = cells(CELL_VECTORS, dict(enumerate(sizes))), cells(CELL_QUERIES, asks)
    left = listed.select("list", "node", "vector", F.pmod(F.xxhash64("node"), rows_cells).cast("int").alias("cell"), F.explode(F.sequence(F.lit(0), ask_cells - 1)).alias("turn"))
    right = probing.select("list", "query", "vector", F.pmod(F.xxhash64("query"), ask_cells).cast("int").alias("turn"), F.explode(F.sequence(F.lit(0), rows_cells - 1)).alias("cell"))
    key = ["list", "cell", "turn"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_search(index, want, block, strictness), "query long, node long, score double")
    nearest = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "node"))), 1, want)
    top = found.groupBy("query").agg(nearest.alias("top")).select("query", F.inline("top"))
    expanded = top.join(distinct.select("node", "ids"), "node").select("query", "far", F.explode("ids").alias("vec_id"))
    answers = expanded.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "vec_id"))), 1, want).alias("near"))
    own = named.join(answers, "query").select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    ranked = own.select("query_id", F.posexplode("near").alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))
