"""Packing documents into sequences: Martello-Toth dominance reduction, then best fit.

Which piece goes where only depends on the pieces' lengths, and there are no more lengths than the capacity.  So the
packing is solved on the histogram of lengths (at most `capacity` counts, whatever the corpus holds), exactly as if piece
by piece:

1. Reduction.  From the longest length on, a set of one to three lengths that dominates every other set with that
   length is fixed, as often as the counts allow, and leaves the instance: a length that nothing fits beside; two that
   fill a sequence; a length with its largest partner if no pair of others is larger in sum; and a length with two
   partners if no other pair beats them.  What dominates costs no sequence against the optimum.
2. Best fit.  What remains goes, longest first, to the fullest sequence that still has room.

The result is a list of patterns with multiplicities.  A piece finds its place by its rank among the pieces of its
length.  Ranks are counted by (length, salt), so a length that a third of all pieces have is ranked in many tasks.

A null or empty text is one piece of the end identifier alone.  Repeated rows are packed each; rows without doc_id are packed like
any other.  An empty table has no pieces.  Texts of any length are cut into pieces.  Other columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.memory import lean
from quire.llm.storage import cut
from quire.llm.tokens import encoder, tokenizer_path, with_end

Pattern = tuple[tuple[int, int], ...]  # (length, times), in the order of their places


# --- the histogram's packing -----------------------------------------------------------------------------------------


class _Counts:
    """Counts by length, with the lengths left in order."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.of = {k: v for k, v in counts.items() if v > 0}
        self.lengths = sorted(self.of)

    def take(self, length: int, times: int) -> None:
        self.of[length] -= times
        if not self.of[length]:
            del self.of[length]
            self.lengths.pop(bisect.bisect_left(self.lengths, length))

    def fitting(self, room: int, without: tuple[int, ...] = ()) -> int | None:
        """The largest length up to room that is still there once `without` are taken."""
        for i in range(bisect.bisect_right(self.lengths, room) - 1, -1, -1):
            x = self.lengths[i]
            if self.of[x] > without.count(x):
                return x
        return None

    def smallest(self, without: tuple[int, ...], k: int) -> list[int]:
        out: list[int] = []
        for x in self.lengths:
            out += [x] * min(k - len(out), self.of[x] - without.count(x))
            if len(out) == k:
                break
        return out


def _best_pair(counts: _Counts, room: int, without: tuple[int, ...], above: int = 0) -> int:
    """The largest sum up to room of two lengths over `above`; 0 if there are none."""
    xs = [x for x in counts.lengths[bisect.bisect_right(counts.lengths, above) : bisect.bisect_right(counts.lengths, room)] if counts.of[x] > without.count(x)]
    best, i, j = 0, 0, len(xs) - 1
    while i <= j:
        s = xs[i] + xs[j]
        if s > room:
            j -= 1
            continue
        if i != j or counts.of[xs[i]] - without.count(xs[i]) > 1:
            best = max(best, s)
        i += 1
    return best


def _dominating(counts: _Counts, w: int, capacity: int) -> tuple[int, ...] | None:
    """A set with w that dominates every other feasible set with w, if one of up to three lengths can be shown to."""
    room = capacity - w
    least = counts.smallest((w,), 3)
    if not least or least[0] > room:
        return (w,)
    partner = counts.fitting(room, (w,))
    assert partner is not None
    if partner == room or len(least) < 2 or least[0] + least[1] > room:
        return (w, partner)
    if len(least) == 3 and sum(least) <= room:
        return None
    if _best_pair(counts, room, (w,)) <= partner:
        return (w, partner)
    third = counts.fitting(room - partner, (w, partner))
    if third is not None and _best_pair(counts, room, (w,), above=third) <= partner:
        return (w, partner, third)
    return None


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """The sets that are fixed, with how often, and the counts that remain."""
    left, fixed, changed = _Counts(counts), [], True
    while changed:
        changed = False
        for w in list(reversed(left.lengths)):
            while w in left.of:
                found = _dominating(left, w, capacity)
                if found is None:
                    break
                need = {x: found.count(x) for x in found}
                times = min(left.of[x] // n for x, n in need.items())
                if len(found) > 1 and not (sum(found) == capacity or times == 1):
                    times = _while_dominating(left, found, need, times, capacity)
                fixed.append((tuple(sorted(need.items(), reverse=True)), times))
                for x, n in need.items():
                    left.take(x, n * times)
                changed = True
    return fixed, dict(left.of)


def _while_dominating(counts: _Counts, found: tuple[int, ...], need: dict[int, int], times: int, capacity: int) -> int:
    """How often found may be fixed at once: its proof holds as long as no length of it runs out, for taking only what
    found is made of leaves the other lengths, and so the sums it was held against, as they were."""
    spare = min((counts.of[x] - 3) // n for x, n in need.items())
    return max(1, min(times, spare))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit, longest first, on counts."""
    open_: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []
    done: list[tuple[Pattern, int]] = []

    def put(room: int, pattern: Pattern, times: int) -> None:
        if not times:
            return
        if room == 0:
            done.append((pattern, times))
        else:
            if room not in open_:
                open_[room] = []
                bisect.insort(rooms, room)
            open_[room].append((pattern, times))

    for w in sorted(counts, reverse=True):
        left = counts[w]
        while left:
            i = bisect.bisect_left(rooms, w)
            if i < len(rooms):
                room = rooms[i]
                pattern, times = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            else:
                room, pattern, times = capacity, (), left
            fill = room // w
            full = min(times, left // fill)
            put(room - fill * w, (*pattern, (w, fill)), full)
            left -= full * fill
            times -= full
            if times and left:  # less than one more sequence takes
                put(room - left * w, (*pattern, (w, left)), 1)
                left, times = 0, times - 1
            if pattern:
                put(room, pattern, times)
    return done + [x for groups in open_.values() for x in groups]


def solve(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    fixed, left = reduce_instance(counts, capacity)
    return fixed + best_fit(left, capacity)


@dataclass
class _Places:
    """For each length, stretches of ranks: first rank, times in a sequence, first sequence, offset of the first."""

    first: dict[int, np.ndarray]
    times: dict[int, np.ndarray]
    sequence: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]

    @staticmethod
    def of(patterns: list[tuple[Pattern, int]]) -> _Places:
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        sequence = 0
        for pattern, count in patterns:
            offset = 0
            for length, times in pattern:
                rows.setdefault(length, []).append((used.get(length, 0), times, sequence, offset))
                used[length] = used.get(length, 0) + times * count
                offset += length * times
            sequence += count
        columns = {k: np.array(v, np.int64).T for k, v in rows.items()}
        return _Places(*({k: v[i] for k, v in columns.items()} for i in range(4)))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        edges = np.flatnonzero(np.diff(length[order])) + 1
        for some in np.split(order, edges):
            if not len(some):
                continue
            w = int(length[some[0]])
            k = np.searchsorted(self.first[w], rank[some], side="right") - 1
            inside, times = rank[some] - self.first[w][k], self.times[w][k]
            sequence[some] = self.sequence[w][k] + inside // times
            offset[some] = self.offset[w][k] + inside % times * w
        return sequence, offset


# --- pieces ----------------------------------------------------------------------------------------------------------

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut_pieces(tokenizer: str, end_id: int | None, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer_path(tokenizer))
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                some = batch.slice(lo, 1024)
                ids, at = code.column(some.column(1))
                if end_id is not None:
                    ids, at = with_end(ids, at, end_id)
                lens = np.diff(at)
                pieces = -(-lens // capacity)
                doc = np.repeat(np.arange(len(lens)), pieces)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * capacity
                length = np.minimum(capacity, lens[doc] - start)
                begin = at[doc] + start
                data = memoryview(ids.astype("<u4").view(np.uint8))
                out = {
                    "doc_id": some.column(0).take(pa.array(doc, pa.int64())),
                    "piece": pa.array(number, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist(), strict=True)], pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)), pa.int32()), pa.array(ids.astype(np.int32), pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    return run


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int | None, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(_cut_pieces(tokenizer, end_id, capacity, with_ids)), PIECES + ", ids array<int>" * with_ids)


def _place(places: _Places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(n)).astype(np.int64) for n in ("length", "rank"))
            sequence, offset = places.find(length, rank)
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def place(pieces: DataFrame, capacity: int, patterns: list[tuple[Pattern, int]] | None = None) -> DataFrame:
    """pieces (any columns, `length` from 1 to capacity) with sequence_id and offset.  pieces must be stable: a table or a checkpoint."""
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    patterns = solve(counts, capacity) if patterns is None else patterns
    total = sum(counts.values())
    salts = 1 << max(8, min(16, (total // 20_000).bit_length()))
    order = [c for c in ("doc_id", "piece", "ids_crc32") if c in pieces.columns]
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    groups = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = groups.select("length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inner = F.row_number().over(Window.partitionBy("length", "__salt").orderBy(*order)) - 1
    ranked = salted.withColumn("__inner", inner).join(bases, ["length", "__salt"]).select(*pieces.columns, (F.col("__base") + F.col("__inner")).cast("long").alias("rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    return ranked.mapInArrow(_place(_Places.of(patterns)), schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int | None = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Cut documents into pieces of at most capacity ids and pack them into as few sequences as it can.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32, its ids if asked for, sequence_id and offset.
    A null text is an empty one, which is its end id alone; without an end id it has no piece.  Rows without doc_id
    and repeated rows are packed like any other.
    """
    return place(cut(cut_pieces(docs, tokenizer, end_id, capacity, id_col, text_col, with_ids)), capacity)
