"""Benchmark decontamination with suffix arrays of the training shards.

A shard is a few megabytes of documents.  Its suffix array holds every word suffix of the shard, ordered by its first `window` words:
words become ranks, and passes of several words each, most significant first, sort what the passes before left equal.
A suffix ends with its document.  The benchmark's suffixes are windows of `window` words (all words of a shorter item); equal
ones are one class.  All classes are searched in the array at once, by bisection, word after word; the interval that is
left holds every place of the window, and each place is compared byte by byte.  From a place that can't be extended to the
left, words are compared forward to the longest verbatim match, with its locations in item and document.

The benchmark is the small side.  It is sent as flat arrays: its lower-cased text and at most 28 bytes a word.  A word and
the space behind it are two bytes or more, so they are at most 15 times the text; blocks of items are made so that this bound is
within `broadcast_bytes`.  Documents are never shuffled: one operator builds a shard's suffix array once and searches the blocks in it in turn,
with one block in memory at a time.  At most BLOCKS blocks are sent at once; a larger benchmark takes several such passes over the documents, each
written by checkpoint() before the next one's blocks are sent.

Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case.  A null or empty text has none.  An item
of fewer words than the window is one window of all its words; an item without words, or without an item_id, is never
found.  Rows of one item_id are one item.  Repeated rows and rows without doc_id are judged like any other.  A text of any
length is one piece; a shard grows to hold it.  Other columns are not read; drop_contaminated returns them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.blocks import byte_ranges, mix, text_bytes
from quire.llm.memory import lean
from quire.llm.storage import cut

SHARD_BYTES = 4 << 20
#: Of the benchmark's arrays that one search sends; ARRAY_BYTES bounds them by the text.
BROADCAST_BYTES = 64 << 20
ARRAY_BYTES = 15
BLOCKS = 16
PAIRS = 1 << 20
RESULT = "doc_id long, n_words long, hit array<struct<first: long, last: long>>, items array<long>, matches array<struct<item_id: long, item_word: long, doc_word: long, n_words: long>>"

_POWERS = mix(np.arange(1, 1025, dtype=np.uint64))
_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = _WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass
class Words:
    """The words of some texts: where each starts and ends in the lower-cased bytes, its text, and its digest."""

    low: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    digest: np.ndarray

    @staticmethod
    def of(body: np.ndarray, at: np.ndarray) -> Words:
        low = _LOWER[body]
        word = _WORD[low]
        first = word.copy()
        first[1:] &= ~word[:-1]
        begin = at[:-1][at[:-1] < len(body)]
        first[begin] = word[begin]
        last = word.copy()
        last[:-1] &= ~word[1:]
        stop = at[1:-1] - 1
        stop = stop[stop >= 0]
        last[stop] = word[stop]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(start):
            none = np.zeros(0, np.int64)
            return Words(low, none, none, none, np.zeros(0, np.uint64))
        total = np.concatenate([[0], np.cumsum(end - start)])
        inside = np.arange(total[-1]) - np.repeat(total[:-1], end - start)
        letters = low[word].astype(np.uint64) + np.uint64(1)
        digest = np.add.reduceat(letters * _POWERS[inside & 1023], total[:-1])
        return Words(low, start, end, np.searchsorted(at, start, side="right") - 1, mix(digest + (end - start).astype(np.uint64)))

    def text(self, raw: bytes, first: int, count: int) -> bytes:
        return b" ".join([raw[a:b] for a, b in zip(self.start[first : first + count].tolist(), self.end[first : first + count].tolist(), strict=True)])


def word_count(body: np.ndarray, at: np.ndarray) -> int:
    """How many words some texts have."""
    word = _WORD[_LOWER[body]]
    first = word.copy()
    first[1:] &= ~word[:-1]
    begin = at[:-1][at[:-1] < len(body)]
    first[begin] = word[begin]
    return int(np.count_nonzero(first))


class SuffixArray:
    """The word suffixes of some texts, ordered by their first `depth` words."""

    def __init__(self, words: Words, edges: np.ndarray, depth: int) -> None:
        """edges: where each text's words start, one more than texts."""
        self.vocabulary, ranks = np.unique(words.digest, return_inverse=True)
        self.ranks = ranks.astype(np.int64) + 1
        self.ends = edges[1:][words.doc]
        self.bits = max(1, len(self.vocabulary).bit_length())
        self.per = min(depth, max(1, 63 // self.bits))  # words in a digit
        digits = self.digit(np.arange(len(self.ranks)), 0, self.per)
        self.order = np.argsort(digits)
        self.leading = digits[self.order]
        head = np.ones(len(digits), bool)
        head[1:] = self.leading[1:] != self.leading[:-1]
        done = self.per
        while done < depth:
            equal = np.flatnonzero(~(head & np.append(head[1:], True)))
            if not len(equal):
                break
            count = min(self.per, depth - done)
            own = self.order[equal]
            digits = self.digit(own, done, count)
            by = np.lexsort((digits, np.cumsum(head)[equal]))
            self.order[equal], digits = own[by], digits[by]
            new = head[equal]
            new[1:] |= digits[1:] != digits[:-1]
            head[equal] = new
            done += count

    def rank(self, suffixes: np.ndarray, depth: int) -> np.ndarray:
        """The rank of each suffix's word at `depth`; 0 behind its end."""
        at = suffixes + depth
        return np.where(at < self.ends[suffixes], self.ranks[np.minimum(at, len(self.ranks) - 1)], 0)

    def digit(self, suffixes: np.ndarray, first: int, count: int) -> np.ndarray:
        out = np.zeros(len(suffixes), np.int64)
        for depth in range(first, first + count):
            out = out << self.bits | self.rank(suffixes, depth)
        return out

    def bisect(self, lo: np.ndarray, hi: np.ndarray, depth: int, want: np.ndarray, after: bool) -> np.ndarray:
        """In each interval lo to hi, where the word at `depth` reaches (or passes) the wanted rank."""
        lo, hi = lo.copy(), hi.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            middle = (lo[open_] + hi[open_]) // 2
            here = self.rank(self.order[middle], depth)
            right = here <= want[open_] if after else here < want[open_]
            lo[open_[right]] = middle[right] + 1
            hi[open_[~right]] = middle[~right]
        return lo

    def intervals(self, ranks: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The stretch of the array that starts with ranks[first : first + size], for each."""
        lo, hi = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        for count in range(1, self.per + 1):
            own = np.flatnonzero(size == count if count < self.per else size >= count)
            digit = np.zeros(len(own), np.int64)
            for depth in range(count):
                digit = digit << self.bits | ranks[first[own] + depth]
            shift = self.bits * (self.per - count)
            lo[own] = np.searchsorted(self.leading, digit << shift, "left")
            hi[own] = np.searchsorted(self.leading, digit + 1 << shift, "left")
        for depth in range(self.per, int(size.max(initial=0))):
            own = np.flatnonzero((lo < hi) & (size > depth))
            want = ranks[first[own] + depth]
            a, b = lo[own], hi[own]
            lo[own], hi[own] = self.bisect(a, b, depth, want, False), self.bisect(a, b, depth, want, True)
        return lo, hi


def _stretches(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every value of every range lo to hi, and which range it is of."""
    count = hi - lo
    which = np.repeat(np.arange(len(lo)), count)
    return np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + lo[which], which


@dataclass
class Hits:
    """What a search found: windows (word of the shard, its length, class), and matches that can't be extended (word of the shard,
    item, word of the item, words)."""

    at: np.ndarray
    size: np.ndarray
    kind: np.ndarray
    matches: np.ndarray


class Index:
    """The benchmark's suffixes in flat arrays."""

    def __init__(self, ids: list[int], texts: list[str | None], window: int) -> None:
        body, at = text_bytes(pa.array(texts, pa.string()))
        words = Words.of(body, at)
        edges = np.searchsorted(words.doc, np.arange(len(ids) + 1))
        self.window, self.ids, self.edges = window, np.array(ids, np.int64), edges
        self.raw = words.low.tobytes()
        self.start, self.end = words.start.astype(np.int32), words.end.astype(np.int32)
        self.item = words.doc.astype(np.int32)
        self.vocabulary, word = np.unique(words.digest, return_inverse=True)
        self.word = word.astype(np.int32)
        length = np.diff(edges)
        size = np.minimum(window, length)[words.doc]
        suffix = np.flatnonzero(np.arange(len(words.doc)) + size <= edges[1:][words.doc])
        suffix = suffix[size[suffix] > 0]
        # Equal windows are neighbours in the benchmark's own suffix array; `first` to `last` are the members of a class.
        if len(suffix):
            own = SuffixArray(words, edges, window)
            place = np.empty(len(own.order), np.int64)
            place[own.order] = np.arange(len(own.order))
            suffix = suffix[np.lexsort((place[suffix], size[suffix]))]
            new = np.ones(len(suffix), bool)
            same = size[suffix[1:]] == size[suffix[:-1]]
            for depth in range(window):
                inside = depth < size[suffix[1:]]
                same &= ~inside | (own.rank(suffix[1:], depth) == own.rank(suffix[:-1], depth))
            new[1:] = ~same
            heads = np.flatnonzero(new)
        else:
            heads = np.zeros(0, np.int64)
        self.members = suffix.astype(np.int32)
        self.first = heads.astype(np.int32)
        self.last = np.append(heads[1:], len(suffix)).astype(np.int32)[: len(heads)]
        self.size = size[suffix[heads]].astype(np.int16 if window < 1 << 15 else np.int32)

    def arrays_bytes(self) -> int:
        """The size of what is sent."""
        return len(self.raw) + sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray))

    def text(self, first: int, count: int) -> bytes:
        return b" ".join([self.raw[a:b] for a, b in zip(self.start[first : first + count].tolist(), self.end[first : first + count].tolist(), strict=True)])

    def search(self, words: Words, edges: np.ndarray, array: SuffixArray | None, with_matches: bool = True) -> Hits:
        """All windows of the benchmark in a shard, whose suffix array has this depth (none: it has no words)."""
        none = np.zeros(0, np.int64)
        if not len(self.first) or array is None:
            return Hits(none, none, none, np.zeros((0, 4), np.int64))
        place = np.searchsorted(array.vocabulary, self.vocabulary)
        known = array.vocabulary[np.minimum(place, len(array.vocabulary) - 1)] == self.vocabulary
        ranks = np.where(known, place + 1, 0)[self.word]
        missing = np.concatenate([[0], np.cumsum(ranks == 0)])
        lead = self.members[self.first].astype(np.int64)
        size = self.size.astype(np.int64)
        kinds = np.flatnonzero(missing[lead + size] == missing[lead])  # a window with a word that the shard lacks isn't there
        lo, hi = array.intervals(ranks, lead[kinds], size[kinds])
        at, which = _stretches(lo, hi)
        at, kind = array.order[at], kinds[which]
        raw = words.low.tobytes()
        texts: dict[int, bytes] = {}
        good = np.ones(len(at), bool)
        for k, (a, c) in enumerate(zip(at.tolist(), kind.tolist(), strict=True)):
            if c not in texts:
                texts[c] = self.text(int(lead[c]), int(size[c]))
            good[k] = words.text(raw, a, int(size[c])) == texts[c]
        at, kind = at[good], kind[good]
        matches = self._longest(words, edges, at, kind) if with_matches and len(at) else np.zeros((0, 4), np.int64)
        return Hits(at, size[kind], kind, matches)

    def same_words(self, low: np.ndarray, start: np.ndarray, end: np.ndarray, digest: np.ndarray) -> np.ndarray:
        """The place in the vocabulary of each word that is one of it, byte for byte; -1 for others."""
        first = np.zeros(len(self.vocabulary), np.int64)
        first[self.word[::-1]] = np.arange(len(self.word))[::-1]
        place = np.minimum(np.searchsorted(self.vocabulary, digest), len(self.vocabulary) - 1)
        sample = first[place]
        alike = (self.vocabulary[place] == digest) & (end - start == self.end[sample] - self.start[sample])
        own = np.flatnonzero(alike)
        at, which = _stretches(start[own].astype(np.int64), end[own].astype(np.int64))
        there = at + (self.start[sample[own]].astype(np.int64) - start[own])[which]
        alike[own[which[low[at] != np.frombuffer(self.raw, np.uint8)[there]]]] = False
        return np.where(alike, place, -1)

    def _longest(self, words: Words, edges: np.ndarray, at: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The matches from windows that can't be extended to the left, as far to the right as they go."""
        # Both sides by the vocabulary's words, not by digests; a word of the benchmark whose digest clashes with another's ends a match.
        mine = self.same_words(words.low, words.start, words.end, words.digest)
        theirs = self.same_words(np.frombuffer(self.raw, np.uint8), self.start, self.end, self.vocabulary[self.word])
        theirs = np.where(theirs < 0, -2, theirs)
        found = []
        many = (self.last - self.first)[kind].astype(np.int64)
        steps = np.searchsorted(np.cumsum(many), np.arange(PAIRS, many.sum() + PAIRS, PAIRS), "left") + 1
        begin = 0
        for stop in [*np.unique(np.minimum(steps, len(at))).tolist(), len(at)]:
            member, which = _stretches(self.first[kind[begin:stop]].astype(np.int64), self.last[kind[begin:stop]].astype(np.int64))
            a, j = at[begin:stop][which], self.members[member].astype(np.int64)
            n = self.size[kind[begin:stop]][which].astype(np.int64)
            begin = stop
            doc, item = words.doc[a], self.item[j]
            inner = (a > edges[doc]) & (j > self.edges[item])
            left = ~(inner & (mine[np.maximum(a - 1, 0)] == theirs[np.maximum(j - 1, 0)]))
            a, j, n, doc, item = a[left], j[left], n[left], doc[left], item[left]
            room = np.minimum(edges[doc + 1] - a, self.edges[item + 1] - j)
            open_ = np.arange(len(a))
            while len(open_ := open_[n[open_] < room[open_]]):
                open_ = open_[mine[a[open_] + n[open_]] == theirs[j[open_] + n[open_]]]
                n[open_] += 1
            found.append(np.stack([a, self.ids[item], j - self.edges[item], n], axis=1))
        return np.concatenate(found)

    def items(self, kind: int) -> set[int]:
        return set(self.ids[self.item[self.members[self.first[kind] : self.last[kind]]]].tolist())


def _cover(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_SPAN = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_PARTS = ("item_id", "item_word", "doc_word", "n_words")
_MATCH = pa.list_(pa.struct([(n, pa.int64()) for n in _PARTS]))


def _shards(column: pa.Array) -> Iterator[tuple[int, int, Words, np.ndarray]]:
    """Runs of rows with their words and where each row's words start."""
    body, at = text_bytes(column)
    for lo, hi in byte_ranges(at, SHARD_BYTES):
        words = Words.of(body[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        yield lo, hi, words, np.searchsorted(words.doc, np.arange(hi - lo + 1))


def _in_turn(sent: list) -> Iterator[Index]:
    """The blocks of the benchmark, one at a time: of several, a worker forgets each before it loads the next."""
    for block in sent:
        yield block.value
        if len(sent) > 1:
            vars(block).pop("_value", None)


def _found(sent: list, window: int, words: Words, edges: np.ndarray, with_matches: bool = True) -> Iterator[tuple[Index, Hits]]:
    """What each block finds in a shard, whose suffix array is built once."""
    array = SuffixArray(words, edges, window) if len(words.start) else None
    for benchmark in _in_turn(sent):
        yield benchmark, benchmark.search(words, edges, array, with_matches)


def _search(sent: list, window: int):
    """Rows of (doc_id, text) or, with what an earlier pass found, (doc_id, text, hit, items, matches) get these blocks' findings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words, edges in _shards(batch.column(1)):
                rows = hi - lo
                spans: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
                items: list[set[int]] = [set() for _ in range(rows)]
                matches: list[list[tuple[int, int, int, int]]] = [[] for _ in range(rows)]
                for benchmark, hits in _found(sent, window, words, edges):
                    doc = words.doc[hits.at]
                    for d, a, n in zip(doc.tolist(), (hits.at - edges[doc]).tolist(), hits.size.tolist(), strict=True):
                        spans[d].append((a, a + n - 1))
                    for d, kind in set(zip(doc.tolist(), hits.kind.tolist(), strict=True)):
                        items[d] |= benchmark.items(kind)
                    for a, item, j, n in hits.matches.tolist():
                        d = int(words.doc[a])
                        matches[d].append((item, j, a - int(edges[d]), n))
                if batch.num_columns > 2:
                    for d, (h, i, m) in enumerate(zip(*(batch.column(k).slice(lo, rows).to_pylist() for k in (2, 3, 4)), strict=True)):
                        spans[d] += [(x["first"], x["last"]) for x in h]
                        items[d] |= set(i)
                        matches[d] += [tuple(x[p] for p in _PARTS) for x in m]
                out = {
                    "doc_id": batch.column(0).slice(lo, rows),
                    "text": batch.column(1).slice(lo, rows),
                    "n_words": pa.array(np.diff(edges), pa.int64()),
                    "hit": pa.array([[{"first": a, "last": b} for a, b in _cover(x)] for x in spans], _SPAN),
                    "items": pa.array([sorted(x) for x in items], pa.list_(pa.int64())),
                    "matches": pa.array([[dict(zip(_PARTS, m, strict=True)) for m in sorted(set(x))] for x in matches], _MATCH),
                }
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run


def _passes(benchmark: DataFrame, window: int, item_col: str, item_text_col: str, broadcast_bytes: int) -> Iterator[list]:
    """The benchmark as broadcast indices whose arrays are of about broadcast_bytes at most (one item is not divided), BLOCKS at a time."""
    if window < 1:
        raise ValueError("a window has at least one word")
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text")).where("id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    blocks = max(1, -(-size * ARRAY_BYTES // broadcast_bytes))
    for begin in range(0, blocks, BLOCKS):
        sent = []
        for k in range(begin, min(blocks, begin + BLOCKS)):
            own = items.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k) if blocks > 1 else items
            table = own.distinct().sort("id", "text").toArrow()
            sent.append(benchmark.sparkSession.sparkContext.broadcast(Index(table.column("id").to_pylist(), table.column("text").to_pylist(), window)))
        yield sent


def _passed(rows: DataFrame, before: list) -> DataFrame:
    """Rows that a pass has written, so that what it was sent can go."""
    rows = cut(rows)
    for block in before:
        block.unpersist()
    return rows


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """For each row of docs: its number of words, the stretches of words inside benchmark windows (first and last word), the
    items found, and the longest verbatim matches with their places."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = RESULT.replace("doc_id long,", "doc_id long, text string,")
    before: list = []
    for sent in _passes(benchmark, window, item_col, item_text_col, broadcast_bytes):
        if before:
            rows = _passed(rows, before).select("doc_id", "text", "hit", "items", "matches")
        rows, before = rows.mapInArrow(lean(_search(sent, window)), schema), sent
    return rows.drop("text")


def _clean(sent: list, window: int, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for lo, _, words, edges in _shards(batch.column(column).cast(pa.large_string())):
                for _, hits in _found(sent, window, words, edges, with_matches=False):
                    keep[lo + words.doc[hits.at]] = False
            yield batch.filter(pa.array(keep))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of docs that hold no benchmark window, as they are; nothing is joined or shuffled."""
    before: list = []
    for sent in _passes(benchmark, window, item_col, item_text_col, broadcast_bytes):
        docs, before = (_passed(docs, before) if before else docs).mapInArrow(lean(_clean(sent, window, docs.columns.index(text_col))), docs.schema), sent
    return docs


def digest(found: DataFrame) -> DataFrame:
    words = F.coalesce(F.aggregate("hit", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1), F.lit(0))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", words.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"))
