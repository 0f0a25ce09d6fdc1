"""Near copies by the Jaccard similarity of their word shingles: the linking rule of drop_near_copies in simhash.py.

Equal texts are one class, known by a digest of 128 bits.  Candidates come from SimHash fingerprints: a class has several of 64 bits each, over its set of
shingles (a bit is 1 if over half of the shingles' hashes have it; of an even number the smallest counts twice, so there are no ties).  Two classes at a
Jaccard of 0.8 agree in a bit with a probability of at least 0.8485, and fingerprints are cut into so many bands of `bits` bits that they
share one with a probability of 0.99999.  Under a key of a band, classes meet by the Hamming distance of two whole fingerprints: DISTANCE of 128 bits are five
standard deviations more than such a pair differs in.  Only pairs whose whole sets of shingles are similar enough are links.  Three rounds keep
the work linear in the size of a group of copies:

1. Each class is compared with the nearest before it under each key; this joins most copies, however many they are.
2. Pairs within DISTANCE that are still in different components are compared, all of them.
3. Where more than `direct` such pairs come to a class under a key, or over HELD classes to a key, no pairs are made: of a group of n classes with
   n (n - 1) / 2 pairs at most `direct` n are sent.  Those classes make clusters, the components of
   "share such a key" (in order of their digests, neighbours are compared in round 1).  Shingles that no other of them has can't be shared, so classes with
   more of these than the similarity allows can have no link and are left out.  The others are dealt to blocks of about `block` classes; the
   component with the most classes of its cluster has blocks of its own, which are not compared with each other.  Each other pair of blocks of a cluster
   meets in one task, which counts the shingles that any two classes share, and gives back not pairs but for each class the smallest that it
   reaches there.  Nothing is left out: what two classes of a cluster have in common is known exactly.  A class is sent once for each block that its own is
   compared with, so what is sent grows with the number of classes outside the largest component times the number of blocks, and sets never go by pair.

A null text is an empty one; texts without words are copies of each other.  Texts of any length are read whole, a set of
shingles is held in one task.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.blocks import byte_ranges, mix, text_bytes
from quire.llm.graph import components, local_roots
from quire.llm.memory import lean, lean_table
from quire.llm.shingles import shingles_of
from quire.llm.storage import cut, partitions

#: How often two sets at a Jaccard of 0.8 agree in a bit: their cosine is 8 / 9 at least.  MISSED of such pairs share no band.
AGREE, MISSED = 1 - math.acos(8 / 9) / math.pi, 0.00001
#: A band has BITS bits; of over 1 << BITS + 7 texts, so many more that some 128 unrelated ones share a key.
BITS = 12
#: Bits of the first two fingerprints that candidates may differ in: unrelated texts differ in 64 +- 6, those at 0.8 in 19 +- 4.
DISTANCE = 40
#: Fingerprints that a pair is compared by before its sets are, behind the first two; and the bits of these 256 that it may differ in: at 0.8 a pair differs in
#: 39 +- 6, the smallest such pair (4 and 5 shingles) in 48 +- 6, unrelated texts in 128 +- 8.
MORE, MORE_DISTANCE = 4, 90
#: Near pairs for each class under one key; in groups with more of them no pairs are made.
DIRECT = 4
#: Classes of one key that are held in one task.
HELD = 512
SUB = 512
#: Classes in a block, about; a pair of blocks has 16 MB of counts at a time.
BLOCK = 1024
#: In a pair of blocks, shingles that more classes have are counted by a product of matrices, rarer ones pair by pair.
OFTEN = 32
#: So many large keys (16 bytes each) or classes (32 bytes each) at most are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 100_000
_CHUNK_BYTES = 1 << 18
_ROWS = 1 << 12


def bands_for(texts: int) -> tuple[int, int, int]:
    """For so many texts: bits of a band, bands, and fingerprints."""
    bits = max(BITS, math.ceil(math.log2(max(1, texts))) - 7)
    bands = math.ceil(math.log(MISSED) / math.log1p(-(AGREE**bits)))
    return bits, bands, -(-bands // (64 // bits))


def _added(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of bits, 64 at a time: one row of ones' places, and the rows that carry."""
    carried = []
    while len(rows) > 2:
        k = len(rows) // 3
        a, b, c = rows[:k], rows[k : 2 * k], rows[2 * k : 3 * k]
        odd = a ^ b
        carried.append(a & b | odd & c)
        rows = np.concatenate([odd ^ c, rows[3 * k :]])
    if len(rows) == 2:
        carried.append(rows[:1] & rows[1:])
        rows = rows[:1] ^ rows[1:]
    return rows, np.concatenate(carried) if carried else rows[:0]


def fingerprints(values: np.ndarray, prints: int) -> np.ndarray:
    """So many fingerprints of a set of shingles (their hashes, in order): a bit is 1 if over half of the shingles have it."""
    if not len(values):
        return np.zeros(prints, np.uint64)
    seed = mix(np.arange(1, prints + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    own = values if len(values) % 2 else np.concatenate([values[:1], values])
    planes: list[np.ndarray] = []
    for lo in range(0, len(own), _ROWS):
        more, place = mix(own[lo : lo + _ROWS, None] ^ seed[None, :]), 0
        while len(more):
            if place == len(planes):
                planes.append(more[:0])
            planes[place], more = _added(np.concatenate([planes[place], more]))
            place += 1
    least = (len(own) + 1) // 2
    over, equal = np.zeros(prints, np.uint64), np.full(prints, ~np.uint64(0))
    for place in range(len(planes) - 1, -1, -1):
        plane = planes[place][0]
        if least >> place & 1:
            equal = equal & plane
        else:
            over, equal = over | equal & plane, equal & ~plane
    return over | equal


def _chunks(column: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    body, at = text_bytes(column)
    for lo, hi in byte_ranges(at, _CHUNK_BYTES):
        yield *shingles_of(body[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], width), hi - lo


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.view(np.int64)))


def _shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    for hashes, owner, docs in _chunks(column, width):
        edges = np.searchsorted(owner, np.arange(docs + 1))
        yield from (np.unique(hashes[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True))


def _prints(width: int, prints: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, own = [], []
            for values in _shingle_sets(batch.column(2), width):
                sizes.append(len(values))
                own.append(fingerprints(values, prints))
            flat = np.concatenate([np.zeros(0, np.uint64), *own])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), _lists(flat, np.full(len(own), prints))], ["id", "mark", "size", "prints"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = list(_shingle_sets(batch.column(1), width))
            sizes = np.array([len(v) for v in own], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(np.concatenate([np.zeros(0, np.uint64), *own]), sizes)], ["digest", "shingles"])

    return run


def _text(text_col: str):
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def _mark(text_col: str):
    """128 bits that stand for a text."""
    return F.unhex(F.md5(_text(text_col).cast("binary")))


def _similar(pairs: DataFrame, sets: DataFrame, tenths: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets have a Jaccard similarity of tenths / 10 or more."""
    side = lambda c: sets.select(F.col("digest").alias(c), F.col("shingles").alias(f"s{c}"))
    ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = ordered.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.size("sa").alias("m"), F.size("sb").alias("n"), F.size(F.array_intersect("sa", "sb")).alias("k"))
    return cut(both.where(F.col("k") * 10 >= (F.col("m") + F.col("n") - F.col("k")) * tenths).select("a", "b"))


def _divided(keyed: DataFrame, by: Column) -> DataFrame:
    """Rows (key, ...) with `part`: null, or for keys of over SUB rows one of so many parts, by the hash `by`, that a part has about SUB."""
    large = keyed.groupBy("key").count().where(F.col("count") > SUB)
    if large.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        large = F.broadcast(large)
    return keyed.join(large, "key", "left").withColumn("part", F.pmod(by, F.ceil(F.col("count") / SUB))).drop("count")


def _near(pairs: DataFrame, classes: DataFrame, tenths: int = 8) -> DataFrame:
    """Those of the pairs (kind, a, b) that differ in at most MORE_DISTANCE bits of MORE further fingerprints, and whose sizes allow the similarity."""
    side = lambda c: classes.select(F.col("digest").alias(c), F.col("size").alias(f"{c}n"), *[F.element_at("prints", 3 + i).alias(f"{c}{i}") for i in range(MORE)])
    bits = reduce(add, [F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(MORE)])
    return cut(pairs.join(side("a"), "a").join(side("b"), "b").where((F.least("an", "bn") * 10 >= F.greatest("an", "bn") * tenths) & (bits <= MORE_DISTANCE)).select("kind", "a", "b"))


def _neighbours(keyed: DataFrame) -> DataFrame:
    """(a, b): each class with the one before it under a key, in order of their digests; and the first of each part of a key with that of the part before."""
    own = Window.partitionBy("key", "part").orderBy("digest")
    placed = _divided(keyed, F.col("digest")).select("key", "part", F.col("digest").alias("a"), F.lag("digest").over(own).alias("b"))
    # Of a key in one part nothing but the pairs is of interest.
    found = cut(placed.where("b is not null or part is not null"))
    between = found.where("b is null").select("a", F.lag("a").over(Window.partitionBy("key").orderBy("part")).alias("b"))
    return found.where("b is not null").select("a", "b").unionByName(between.where("b is not null"))


NEAREST, NEAR, MEMBER = 0, 1, 2


def near_pairs(key: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, bits): rows i < j of one key whose fingerprints (p, q) differ in at most DISTANCE bits; rows are ordered by key."""
    end = np.searchsorted(key, key, side="right")
    i, j, bits = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
    at, step = np.arange(len(key)), 1
    while True:
        at = at[at + step < end[at]]
        if not len(at):
            return np.concatenate(i), np.concatenate(j), np.concatenate(bits)
        far = np.bitwise_count(p[at] ^ p[at + step]) + np.bitwise_count(q[at] ^ q[at + step])
        near = far <= DISTANCE
        i.append(at[near])
        j.append(at[near] + step)
        bits.append(far[near])
        step += 1


def _meet(direct: int, held: int):
    """Rows (key, digest, p, q), ordered by key and digest, to (kind, a, b): a candidate pair, of the nearest before b or another; or a member b of the large group a."""

    def emit(kind: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["kind", "a", "b"])

    def groups(key: np.ndarray, digest: np.ndarray, p: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        i, j, bits = near_pairs(key, p, q)
        if not len(i):
            return
        nodes, roots = local_roots(i, j)
        pairs, members = np.bincount(roots[np.searchsorted(nodes, i)], minlength=len(key)), np.bincount(roots, minlength=len(key))
        large = pairs > direct * members
        of = large[roots]
        yield emit(np.full(of.sum(), MEMBER), digest[roots[of]], digest[nodes[of]])
        few = ~large[roots[np.searchsorted(nodes, i)]]
        i, j, bits = i[few], j[few], bits[few]
        order = np.lexsort((i, bits, j))
        i, j = i[order], j[order]
        yield emit(np.where(np.diff(j, prepend=-1) != 0, NEAREST, NEAR), digest[i], digest[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
        hot: int | None = None
        for batch in batches:
            new = [np.asarray(batch.column(c)).view(x.dtype) for c, x in enumerate(rows)]
            if hot is not None:
                more = new[0] == hot
                yield emit(np.full(more.sum(), MEMBER), ~new[0][more], new[1][more])
                new = [x[~more] for x in new]
            rows = [np.concatenate(x) for x in zip(rows, new, strict=True)]
            if not len(rows[0]):
                continue
            # Keys of over `held` rows are large as a whole, the others are compared; the last key may go on in the next batch.
            last = rows[0][-1]
            own, sizes = np.unique(rows[0], return_counts=True)
            much = np.isin(rows[0], own[sizes > held])
            yield emit(np.full(much.sum(), MEMBER), ~rows[0][much], rows[1][much])
            hot = int(last) if much[-1] else None
            done = ~much & (rows[0] != last)
            yield from groups(*(x[done] for x in rows))
            rows = [x[~much & (x0 == last)] for x, x0 in ((x, rows[0]) for x in rows)]
        if len(rows[0]):
            yield from groups(*rows)

    return run


def candidates(classes: DataFrame, bits: int, bands: int, direct: int = DIRECT, held: int = HELD) -> DataFrame:
    """(kind, a, b) of classes (digest, prints): pairs that share a band and differ in at most DISTANCE bits of two fingerprints, those of a class with the
    nearest before it marked; and members of groups that are too large for pairs."""
    per = 64 // bits
    print_of = F.element_at("prints", (F.col("band") / per).cast("int") + 1)
    value = F.expr(f"shiftrightunsigned(print, (band % {per}) * {bits})").bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    rows = classes.select("digest", "prints", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))
    rows = rows.select("digest", "band", print_of.alias("print"), F.element_at("prints", 1).alias("p"), F.element_at("prints", 2).alias("q"))
    keyed = rows.select((F.col("band").cast("long") * (1 << bits) + value).alias("key"), "digest", "p", "q")
    dealt = keyed.repartition(partitions(classes.sparkSession), "key").sortWithinPartitions("key", "digest")
    return dealt.mapInArrow(lean(_meet(direct, held)), "kind int, a long, b long")


def shared_counts(values: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """How many values any two of the rows have in common; a row's values differ from each other."""
    order = np.argsort(values, kind="stable")
    ranked, own = values[order], owner[order]
    edge = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    size = np.diff(np.append(edge, len(ranked)))
    counts = np.zeros(rows * rows, np.float32)
    for c in range(2, OFTEN + 1):  # lists of one length at a time
        lists = own[edge[size == c][:, None] + np.arange(c)]
        for lo in range(0, len(lists), max(1, (1 << 20) // c)):
            part = lists[lo : lo + max(1, (1 << 20) // c)]
            for step in range(1, c):
                both = np.concatenate([part[:, step:] * rows + part[:, :-step], part[:, :-step] * rows + part[:, step:]]).ravel()
                counts += np.bincount(both, minlength=rows * rows) if len(both) * 8 > rows * rows else 0
                if len(both) * 8 <= rows * rows:
                    np.add.at(counts, both, 1)
    counts = counts.reshape(rows, rows)
    often = np.flatnonzero(size > OFTEN)
    for lo in range(0, len(often), 1024):
        has = np.zeros((rows, min(1024, len(often) - lo)), np.float32)
        for k, at in enumerate(often[lo : lo + 1024].tolist()):
            has[own[edge[at] : edge[at] + size[at]], k] = 1
        counts += has @ has.T
    return counts


def _compare(tenths: int):
    """A pair of blocks: rows (digest, root, shingles) to (a, b): classes and the smallest that each reaches over links of this task."""

    def run(table: pa.Table) -> pa.Table:
        digest, root = np.asarray(table.column("digest").combine_chunks()), np.asarray(table.column("root").combine_chunks())
        column = table.column("shingles").combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
        at = np.asarray(column.offsets).astype(np.int64)
        sizes = np.diff(at)
        counts = shared_counts(np.asarray(column.values)[at[0] : at[-1]], np.repeat(np.arange(len(digest)), sizes), len(digest))
        linked = (counts * 10 >= (sizes[:, None] + sizes[None, :] - counts) * tenths) & (root[:, None] != root[None, :])
        i, j = np.nonzero(np.triu(linked, 1))
        nodes, roots = local_roots(digest[i], digest[j]) if len(i) else (np.zeros(0, np.int64),) * 2
        other = nodes != roots
        return pa.table({"a": pa.array(nodes[other], pa.int64()), "b": pa.array(roots[other], pa.int64())})

    return run


def _cluster_links(large: DataFrame, sets: DataFrame, tenths: int, block: int) -> DataFrame:
    """(a, b) with the components of all links between classes of different roots that are of one cluster; large: (key, digest, root)."""
    meet = large.select("digest", F.min("digest").over(Window.partitionBy("key")).alias("least")).distinct()
    clusters = components(meet, "digest", "least")
    classes = large.select("digest", "root").distinct()
    own = classes.join(clusters.select(F.col("node").alias("digest"), F.col("root").alias("cluster")), "digest").join(sets, "digest")
    lone = own.select("digest", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n"), F.min("digest").alias("d")).where("n = 1").groupBy("d").agg(F.count("*").alias("lone"))
    size = F.size("shingles")
    able = cut(own.join(lone, own["digest"] == lone["d"], "left").where((size - F.coalesce("lone", F.lit(0))) * 10 >= size * tenths).select("cluster", "digest", "root", "shingles"))
    # Blocks of the largest component, and blocks of all others.
    by_root = able.groupBy("cluster", "root").count()
    shape = by_root.groupBy("cluster").agg(F.max_by("root", F.struct("count", "root")).alias("major"), F.max("count").alias("most"), F.sum("count").alias("all"))
    shape = shape.where(F.col("most") < F.col("all")).select("cluster", "major", F.ceil(F.col("most") / block).cast("int").alias("majors"), F.ceil((F.col("all") - F.col("most")) / block).cast("int").alias("others"))
    shape = cut(shape)
    if shape.count() <= BROADCAST_KEYS:
        shape = F.broadcast(shape)
    placed = able.join(shape, "cluster")
    is_major = F.col("root") == F.col("major")
    # Blocks of others are numbered from 0, those of the major component behind them.
    number = F.when(is_major, F.col("others") + F.pmod(F.xxhash64("digest"), F.col("majors"))).otherwise(F.pmod(F.xxhash64("digest"), F.col("others"))).cast("int")
    partners = F.when(is_major, F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("others") + F.col("majors") - 1))
    pairs = placed.withColumn("number", number).select("cluster", "digest", "root", "shingles", "number", F.explode(partners).alias("other"))
    keyed = pairs.select("cluster", F.least("number", "other").alias("i"), F.greatest("number", "other").alias("j"), "digest", "root", "shingles")
    # What a join has dealt by cluster would do for these groups too, with all pairs of a cluster's blocks in one task.
    keyed = keyed.repartition(partitions(large.sparkSession), "cluster", "i", "j")
    return cut(keyed.groupBy("cluster", "i", "j").applyInArrow(lean_table(_compare(tenths)), "a long, b long"))


def component_classes(docs: DataFrame, width: int = 5, tenths: int = 8, id_col: str = "doc_id", text_col: str = "text", direct: int = DIRECT, block: int = BLOCK) -> DataFrame:
    """(digest, mark, id, root): each distinct text with a number of its own, its digest, the smallest doc_id that has it, and its component."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), _mark(text_col).alias("mark"), _text(text_col).alias("text"))
    bits, bands, prints = bands_for(docs.count())
    grouped = rows.mapInArrow(lean(_prints(width, prints)), "id long, mark binary, size int, prints array<long>").groupBy("mark").agg(F.min("id").alias("id"), F.min("size").alias("size"), F.min("prints").alias("prints"))
    classes = cut(grouped.withColumn("digest", F.monotonically_increasing_id()))
    # A pair is found under several keys.
    found = cut(candidates(classes, bits, bands, direct).groupBy(F.greatest("kind", F.lit(NEAR)).alias("what"), "a", "b").agg(F.min("kind").alias("kind")))
    pairs, members = _near(found.where(F.col("kind") < MEMBER), classes, tenths), found.where(F.col("kind") == MEMBER).select(F.col("a").alias("key"), F.col("b").alias("digest"))
    any_large = not members.isEmpty()
    first = pairs.where(F.col("kind") == NEAREST).select("a", "b")
    neighbours = cut(first.unionByName(_neighbours(members)).distinct()) if any_large else first
    # Only classes with a candidate have a set made.
    near = pairs.select(F.explode(F.array("a", "b")).alias("d")).unionByName(members.select(F.col("digest").alias("d"))).distinct()
    few = cut(classes.select("digest", "mark", "id").join(near, F.col("digest") == F.col("d"), "left_semi"))
    # One row of each class: by id as well, so that copies of one text don't meet in one task.  Texts are only sent where these keys are many.
    wanted = few.select(F.col("mark").alias("m"), F.col("id").alias("i"), "digest")
    if few.count() <= BROADCAST_KEYS:
        wanted = F.broadcast(wanted)
    texts = rows.join(wanted, (F.col("mark") == F.col("m")) & F.col("id").eqNullSafe(F.col("i"))).select("digest", "text")
    sets = cut(texts.mapInArrow(lean(_sets(width)), "digest long, shingles array<long>").dropDuplicates(["digest"]))
    links = _similar(neighbours, sets, tenths)
    roots = components(links)
    rooted = cut(few.join(roots, F.col("digest") == F.col("node"), "left").select("digest", F.coalesce("root", "digest").alias("root")))
    side = lambda c: rooted.select(F.col("digest").alias(c), F.col("root").alias(f"r{c}"))
    later = _similar(pairs.where(F.col("kind") == NEAR).select("a", "b").join(side("a"), "a").join(side("b"), "b").where("ra <> rb"), sets, tenths)
    if any_large:
        own = members.join(rooted, "digest")
        keys = own.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key")
        large = cut(own.join(keys, "key").select("key", "digest", "root"))
        if not large.isEmpty():
            later = later.unionByName(_cluster_links(large, sets, tenths, block))
    if not later.isEmpty():
        roots = components(links.unionByName(later))
    return classes.join(roots, classes["digest"] == roots["node"], "left").select("digest", "mark", "id", F.coalesce("root", "digest").alias("root"))


def keep_rows(marked: DataFrame, kept: DataFrame, id_col: str, mark: str, columns: list[str]) -> DataFrame:
    """One row for each (__id, __kept) of kept: of equal id and mark, the one whose digest over all columns is smallest.  Copies are
    left out before anything is shuffled; the join reuses the partitioning."""
    key = marked.withColumn("__key", F.col(id_col).cast("long"))
    first = Window.partitionBy("__key", mark).orderBy(F.xxhash64(*[F.col(c) for c in columns]))
    once = key.withColumn("__place", F.row_number().over(first)).where("__place = 1")
    return once.join(kept, (F.col("__key") == F.col("__id")) & (F.col(mark) == F.col("__kept")), "left_semi").select(*columns)


def keep_first(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component one row with its smallest doc_id; rows without doc_id stay.  Rows to drop and repeated ones are known by their keys; if these are
    few, nothing else of a text is shuffled than repeated rows.  Else the texts are shuffled once, by id and digest."""
    kept = classes.where("id is not null").groupBy("root").agg(F.min(F.struct("id", "mark")).alias("k")).select(F.col("k.id").alias("__id"), F.col("k.mark").alias("__kept"))
    marked = docs.where(F.col(id_col).isNotNull()).withColumn("__digest", _mark(text_col))
    keys = marked.select(F.col(id_col).cast("long").alias("__own"), F.col("__digest").alias("__mark")).groupBy("__own", "__mark").agg(F.count("*").alias("__n"))
    staying = kept.withColumn("__stays", F.lit(True))
    judged = keys.join(staying, (F.col("__own") == F.col("__id")) & (F.col("__mark") == F.col("__kept")), "left").select("__own", "__mark", "__n", F.coalesce("__stays", F.lit(False)).alias("__stays"))
    special = cut(judged.where("__n > 1 or not __stays"))
    without_id = docs.where(F.col(id_col).isNull())
    if special.count() > BROADCAST_KEYS:
        return keep_rows(marked, kept, id_col, "__digest", docs.columns).unionByName(without_id)
    met = marked.join(F.broadcast(special), (F.col(id_col).cast("long") == F.col("__own")) & (F.col("__digest") == F.col("__mark")), "left")
    alone = met.where("__stays is null").select(*docs.columns)
    repeated = keep_rows(met.where("__stays").select(*docs.columns, "__digest"), kept, id_col, "__digest", docs.columns)
    return alone.unionByName(repeated).unionByName(without_id)
