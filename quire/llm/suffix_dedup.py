"""Exact substring dedup by a depth-limited, most-significant-digit radix sort of suffixes.

Suffixes are ordered only through the first `threshold` bytes; the groups that are still equal then are exactly the
repeated windows.  The sort runs in passes, and each pass drops the suffixes that are already alone.

1. The leading digit of a window is the smallest 64-bit digest among its 16-byte grams.  Neighbouring windows mostly
   share it, so a run of windows with one leading digit travels as one record.  Each block sends the distinct
   digits it holds to the digit's bucket, and learns which ones another block holds too.  All others are alone.
2. Only runs whose leading digit is shared are sent with their bytes, each distinct one once for a block with the
   smallest document that holds it.  A bucket orders their windows digit by digit, eight bytes a pass, and answers
   for each run which of its windows start in a smaller document.
3. Each block marks the bytes that those windows cover.

A digit or a run that a third of all documents hold is sent once by each block, so no bucket is hot.  Digests only
choose what to compare; equality is decided on the bytes.  Copies of whole documents are known after the first pass
(a 256-bit digest) and send nothing in the second.

Defined results: a null text is an empty one; matches never cross documents; rows that share a doc_id never remove
from each other; a row without doc_id neither removes nor loses anything.  A text of any length is handled whole, in
memory in proportion to the longest one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.blocks import _M1, Block, block_table, buckets_of, digest_buckets, mix, words64
from quire.llm.memory import lean, lean_table
from quire.llm.storage import cut

GRAM = 16
REPLY = "block long, bucket int, kind int, payload binary"
SENT = "bucket int, block long, payload binary"
_PIECE = 1 << 20


def _squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _expand(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def leading_digits(body: np.ndarray, threshold: int) -> np.ndarray:
    """The leading digit of the window at each position (as many as there are windows in body)."""
    n = len(body) - threshold + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    gram = min(GRAM, threshold)
    out = np.empty(n, np.uint64)
    for lo in range(0, n, _PIECE):
        hi = min(n, lo + _PIECE)
        part = body[lo : hi + threshold - 1]
        x = words64(part)
        grams = len(part) - gram + 1
        if gram >= 8:
            g = mix(x[:grams] ^ mix(x[gram - 8 : gram - 8 + grams] * _M1))
        else:
            g = mix(x[:grams] >> np.uint64(8 * (8 - gram)))
        width, left = 1, threshold - gram + 1
        while width * 2 <= left:
            g = np.minimum(g[:-width], g[width:])
            width *= 2
        if left > width:
            g = np.minimum(g[: len(g) - (left - width)], g[left - width :])
        out[lo:hi] = g[: hi - lo]
    return out


class _Runs:
    """The runs of windows of a block that share a leading digit, in order of position."""

    def __init__(self, block: Block, threshold: int) -> None:
        body, at = block.body, block.offsets
        digits = leading_digits(body, threshold)
        n = len(digits)
        valid = np.zeros(n + 1, np.int8)
        lens = np.diff(at)
        long = lens >= threshold
        begin, end = at[:-1][long], at[1:][long] - threshold + 1
        np.add.at(valid, begin, 1)
        np.add.at(valid, end, -1)
        inside = np.cumsum(valid[:-1]) > 0
        first = np.zeros(n, bool)
        first[begin] = True
        if n:
            changed = np.ones(n, bool)
            changed[1:] = digits[1:] != digits[:-1]
            starts = np.flatnonzero(inside & (changed | first))
            close = np.zeros(n + 1, bool)
            close[starts] = True
            close[end] = True
            cuts = np.flatnonzero(close)
            ends = cuts[np.searchsorted(cuts, starts) + 1]
        else:
            starts = ends = np.zeros(0, np.int64)
        self.start, self.end, self.digit = starts, ends, digits[starts] if n else np.zeros(0, np.uint64)
        self.doc = np.searchsorted(at, starts, side="right") - 1
        self.windows = n

    def keep(self, mask: np.ndarray) -> None:
        self.start, self.end, self.digit, self.doc = self.start[mask], self.end[mask], self.digit[mask], self.doc[mask]


def _texts(block: Block) -> list[bytes]:
    raw = block.body.tobytes()
    return [hashlib.sha256(raw[a:b]).digest() for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True)]


def _digit_lists(block: Block, runs: _Runs, count: int) -> list[tuple[int, np.ndarray]]:
    """The distinct leading digits of a block by bucket, in order."""
    digits = np.unique(runs.digit)
    bucket = buckets_of(digits, count)
    order = np.argsort(bucket, kind="stable")
    digits, bucket = digits[order], bucket[order]
    edges = np.flatnonzero(np.diff(bucket)) + 1
    return [(int(bucket[a]), digits[a:b]) for a, b in zip([0, *edges], [*edges, len(digits)], strict=True) if b > a]


def _text_lists(block: Block, count: int) -> dict[int, list[tuple[bytes, int]]]:
    least: dict[bytes, int] = {}
    for key, doc, ok in zip(_texts(block), block.ids.tolist(), block.known.tolist(), strict=True):
        if ok and (key not in least or doc < least[key]):
            least[key] = doc
    out: dict[int, list[tuple[bytes, int]]] = {}
    for key, doc in least.items():
        out.setdefault(int.from_bytes(key[:8], "big") % count, []).append((key, doc))
    return out


def _send_digits(threshold: int, count: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block.of(batch, i)
                runs = _Runs(block, threshold)
                runs.keep(block.known[runs.doc])
                texts = _text_lists(block, count)
                lists = dict(_digit_lists(block, runs, count))
                buckets = sorted(lists.keys() | texts.keys())
                payload = []
                for b in buckets:
                    own = texts.get(b, [])
                    payload.append(len(own).to_bytes(4, "little") + b"".join(k for k, _ in own) + np.array([d for _, d in own], np.int64).tobytes() + lists.get(b, np.zeros(0, np.uint64)).tobytes())
                if buckets:
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array(buckets, pa.int32()), "block": pa.array([block.block] * len(buckets), pa.int64()), "payload": pa.array(payload, pa.binary())})

    return run


def _shared_digits(table: pa.Table) -> pa.Table:
    """For each block, which of the digits it sent another block sent too, and which of its texts a smaller document has."""
    rows = sorted(zip(table.column("block").to_pylist(), table.column("payload").to_pylist(), strict=True))
    bucket = table.column("bucket")[0].as_py()
    digits, texts = [], []
    for _, raw in rows:
        n = int.from_bytes(raw[:4], "little")
        texts.append(([raw[4 + 32 * i : 36 + 32 * i] for i in range(n)], np.frombuffer(raw, np.int64, n, 4 + 32 * n)))
        digits.append(np.frombuffer(raw, np.uint64, -1, 4 + 40 * n))
    every = np.concatenate(digits)
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    same = ordered[1:] == ordered[:-1]
    shared = np.zeros(len(every), bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    least: dict[bytes, int] = {}
    for keys, docs in texts:
        for key, doc in zip(keys, docs.tolist(), strict=True):
            if key not in least or doc < least[key]:
                least[key] = doc
    blocks, payload, at = [], [], 0
    for (block, _), own, (keys, docs) in zip(rows, digits, texts, strict=True):
        flags = shared[at : at + len(own)]
        at += len(own)
        smaller = np.array([least[k] for k in keys], np.int64)
        if flags.any() or (smaller < docs).any():
            blocks.append(block)
            payload.append(_squeeze(len(keys).to_bytes(4, "little") + smaller.tobytes() + np.packbits(flags).tobytes()))
    return pa.table({"block": pa.array(blocks, pa.int64()), "bucket": pa.array([bucket] * len(blocks), pa.int32()), "kind": pa.array([1] * len(blocks), pa.int32()), "payload": pa.array(payload, pa.binary())})


class _State:
    """What a block knows after the first pass: the runs that others may hold, and its documents that are copies."""

    def __init__(self, block: Block, replies: pa.Table, threshold: int, count: int) -> None:
        runs = _Runs(block, threshold)
        runs.keep(block.known[runs.doc])
        lists, texts = _digit_lists(block, runs, count), _text_lists(block, count)
        first = {b: _expand(raw) for b, kind, raw in zip(*(replies.column(c).to_pylist() for c in ("bucket", "kind", "payload")), strict=True) if kind == 1}
        live, least = [], {}
        for b, digits in lists:
            if raw := first.get(b):
                n = int.from_bytes(raw[:4], "little")
                flags = np.unpackbits(np.frombuffer(raw, np.uint8, -1, 4 + 8 * n), count=len(digits)).astype(bool)
                live.append(digits[flags])
        for b, own in texts.items():
            raw = first.get(b)
            docs = np.frombuffer(raw, np.int64, len(own), 4).tolist() if raw else [d for _, d in own]
            least |= {key: doc for (key, _), doc in zip(own, docs, strict=True)}
        self.hashes = _texts(block)
        self.copy = np.array([ok and least[key] < doc for key, doc, ok in zip(self.hashes, block.ids.tolist(), block.known.tolist(), strict=True)], bool)
        runs.keep(~self.copy[runs.doc])
        again, times = np.unique(runs.digit, return_counts=True)
        live.append(again[times > 1])
        runs.keep(np.isin(runs.digit, np.unique(np.concatenate(live))))
        self.runs = runs
        raw, least_of, texts_of = block.body.tobytes(), {}, []
        for a, b, doc in zip(runs.start.tolist(), runs.end.tolist(), block.ids[runs.doc].tolist(), strict=True):
            text = raw[a : b + threshold - 1]
            texts_of.append(text)
            if text not in least_of or doc < least_of[text]:
                least_of[text] = doc
        self.texts, self.least = texts_of, least_of
        digit_of = dict(zip(texts_of, runs.digit.tolist(), strict=True))
        distinct = list(least_of)
        bucket = buckets_of(np.array([digit_of[t] for t in distinct], np.uint64), count).tolist() if distinct else []
        self.sent: dict[int, list[bytes]] = {}
        for b, text in zip(bucket, distinct, strict=True):
            self.sent.setdefault(b, []).append(text)


def _send_runs(threshold: int, count: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        blocks, buckets, payload = [], [], []
        for i in range(left.num_rows):
            block = Block.of(left, i)
            state = _State(block, right, threshold, count)
            for b, texts in sorted(state.sent.items()):
                head = np.array([[state.least[t], len(t)] for t in texts], np.int64)
                blocks.append(block.block)
                buckets.append(b)
                payload.append(_squeeze(len(texts).to_bytes(4, "little") + head.tobytes() + b"".join(texts)))
        return pa.table({"bucket": pa.array(buckets, pa.int32()), "block": pa.array(blocks, pa.int64()), "payload": pa.array(payload, pa.binary())})

    return run


def radix_groups(body: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order the strings of depth bytes at starts, digit by digit, inside the groups given.

    Strings that a pass leaves alone are dropped.  Returns the indices left, ordered, and the group of each: indices of one
    group have equal strings.
    """
    index = np.argsort(group, kind="stable")
    group = group[index]
    words = words64(body)
    for at in [*range(0, depth - 8, 8), max(0, depth - 8)]:
        if not len(index):
            break
        digit = words[starts[index] + at]
        if depth < 8:
            digit = digit >> np.uint64(8 * (8 - depth))
        order = np.lexsort((digit, group))
        index, group, digit = index[order], group[order], digit[order]
        new = np.ones(len(index), bool)
        new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        group = np.cumsum(new) - 1
        alone = new & np.append(new[1:], True)
        index, group = index[~alone], group[~alone]
    return index, group


def _order_runs(threshold: int):
    """For each block, the windows of the runs it sent that start in a smaller document."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("block").to_pylist(), table.column("payload").to_pylist(), strict=True))
        bucket = table.column("bucket")[0].as_py()
        number: dict[bytes, int] = {}
        least: list[int] = []
        sent = []
        for block, raw in rows:
            raw = _expand(raw)
            n = int.from_bytes(raw[:4], "little")
            head = np.frombuffer(raw, np.int64, 2 * n, 4).reshape(n, 2)
            own, at = [], 4 + 16 * n
            for doc, length in head.tolist():
                text = raw[at : at + length]
                at += length
                k = number.setdefault(text, len(least))
                if k == len(least):
                    least.append(doc)
                elif doc < least[k]:
                    least[k] = doc
                own.append((k, doc))
            sent.append((block, own))
        texts = list(number)
        low = np.array(least, np.int64)
        lens = np.array([len(t) for t in texts], np.int64)
        at = np.concatenate([[0], np.cumsum(lens)])
        body = np.frombuffer(b"".join(texts), np.uint8)
        windows = lens - threshold + 1
        # The leading digit of a run is that of any of its windows; a digit with one distinct run needs no ordering.
        lead = leading_digits(body, threshold)[at[:-1]]
        digit, digit_of, times = np.unique(lead, return_inverse=True, return_counts=True)
        many = times[digit_of] > 1
        run_of = np.repeat(np.flatnonzero(many), windows[many])
        base = np.concatenate([[0], np.cumsum(windows[many])])[:-1]
        starts = np.arange(len(run_of)) - np.repeat(base, windows[many]) + at[run_of]
        first = low[run_of]
        index, group = radix_groups(body, starts, digit_of[run_of], threshold)
        if len(index):
            edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            smallest = np.minimum.reduceat(low[run_of[index]], edge)
            first[index] = np.repeat(smallest, np.diff(np.append(edge, len(index))))
        base_of = np.zeros(len(texts), np.int64)
        base_of[np.flatnonzero(many)] = base
        many_l, windows_l, base_l = many.tolist(), windows.tolist(), base_of.tolist()
        blocks, payload = [], []
        for block, own in sent:
            kinds, masks = bytearray(len(own)), []
            for i, (k, doc) in enumerate(own):
                if not many_l[k]:
                    kinds[i] = 1 if least[k] < doc else 0
                    continue
                gone = first[base_l[k] : base_l[k] + windows_l[k]] < doc
                kinds[i] = 1 if gone.all() else 2 if gone.any() else 0
                if kinds[i] == 2:
                    masks.append(np.packbits(gone).tobytes())
            if any(kinds):
                blocks.append(block)
                payload.append(_squeeze(bytes(kinds) + b"".join(masks)))
        return pa.table({"block": pa.array(blocks, pa.int64()), "bucket": pa.array([bucket] * len(blocks), pa.int32()), "kind": pa.array([2] * len(blocks), pa.int32()), "payload": pa.array(payload, pa.binary())})

    return run


def _spans(gone: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of gone bytes, none across a document's edge."""
    if not len(gone):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(gone) + 1, bool)
    edge[at] = True
    before = np.concatenate([[False], gone[:-1]])
    after = np.concatenate([gone[1:], [False]])
    return np.flatnonzero(gone & (~before | edge[:-1])), np.flatnonzero(gone & (~after | edge[1:])) + 1


def _remove(threshold: int, count: int, whole_chars: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for i in range(left.num_rows):
            block = Block.of(left, i)
            state = _State(block, right, threshold, count)
            runs, n = state.runs, len(block.body)
            second = {b: _expand(raw) for b, kind, raw in zip(*(right.column(c).to_pylist() for c in ("bucket", "kind", "payload")), strict=True) if kind == 2}
            verdict: dict[bytes, bytes | bool] = {}
            for b, texts in state.sent.items():
                if raw := second.get(b):
                    at = len(texts)
                    for kind, text in zip(raw, texts, strict=False):
                        if kind == 1:
                            verdict[text] = True
                        elif kind == 2:
                            size = (len(text) - threshold + 8) // 8
                            verdict[text] = raw[at : at + size]
                            at += size
            starts = np.zeros(n + 1, np.int32)
            ids = block.ids[runs.doc].tolist()
            for a, b, text, doc in zip(runs.start.tolist(), runs.end.tolist(), state.texts, ids, strict=True):
                if doc > state.least[text] or verdict.get(text) is True:
                    starts[a] += 1
                    starts[b] -= 1
                elif mask := verdict.get(text):
                    hit = a + np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8), count=b - a))
                    starts[hit] += 1
                    starts[hit + 1] -= 1
            window = np.cumsum(starts[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(window)])
            position = np.arange(1, n + 1)
            gone = total[position] - total[np.maximum(position - threshold, 0)] > 0
            lens = np.diff(block.offsets)
            if n:
                gone |= np.repeat(state.copy & (lens >= threshold), lens)
            if whole_chars and n:
                head = (block.body & 0xC0) != 0x80
                char = np.cumsum(head) - 1
                kept_part = np.zeros(int(char[-1]) + 1 if char[-1] >= 0 else 1, bool)
                kept_part[char[~gone]] = True
                gone &= ~kept_part[char]
            a, b = _spans(gone, block.offsets)
            kept = block.body[~gone].tobytes()
            left_over = np.concatenate([[0], np.cumsum(~gone)])[block.offsets]
            cut_at = np.searchsorted(a, block.offsets)
            pairs = pa.StructArray.from_arrays([pa.array(a - block.offsets[np.searchsorted(block.offsets, a, side="right") - 1], pa.int64()), pa.array(b - a, pa.int64())], ["start", "length"])
            out.append(
                pa.table(
                    {
                        "doc_id": pa.array(block.ids, pa.int64(), mask=~block.known),
                        "n_bytes": pa.array(lens, pa.int64()),
                        "n_removed": pa.array(lens - np.diff(left_over), pa.int64()),
                        "spans": pa.ListArray.from_arrays(pa.array(cut_at, pa.int32()), pairs),
                        "kept": pa.array([kept[x:y] for x, y in zip(left_over[:-1].tolist(), left_over[1:].tolist(), strict=True)], pa.binary()),
                        "source_sha256": pa.array([h.hex() for h in state.hashes], pa.string()),
                    }
                )
            )
        return pa.concat_tables(out) if out else _EMPTY

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, length: long>>, kept binary, source_sha256 string"
_EMPTY = pa.table(
    {
        "doc_id": pa.array([], pa.int64()),
        "n_bytes": pa.array([], pa.int64()),
        "n_removed": pa.array([], pa.int64()),
        "spans": pa.array([], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
        "kept": pa.array([], pa.binary()),
        "source_sha256": pa.array([], pa.string()),
    }
)


def suffix_dedup(docs: DataFrame, threshold: int = 50, id_col: str = "doc_id", text_col: str = "text", whole_chars: bool = False) -> DataFrame:
    """Remove every byte of a document that a window of `threshold` bytes covers which also starts in a document with a
    smaller id.  Returns, for each row of docs, doc_id, n_bytes, n_removed, the removed spans in order, the bytes kept, and
    the SHA-256 of the whole text.

    whole_chars keeps a character whole unless all of its bytes would go, so that what is kept is valid UTF-8.
    """
    if threshold < 1:
        raise ValueError("threshold is at least 1")
    table = block_table(docs, id_col, text_col, "suffix")
    count, _ = digest_buckets(table)
    sent = table.mapInArrow(lean(_send_digits(threshold, count)), SENT)
    first = cut(sent.groupBy("bucket").applyInArrow(_shared_digits, REPLY))
    by_block = table.groupBy("block")
    runs = by_block.cogroup(first.groupBy("block")).applyInArrow(lean_table(_send_runs(threshold, count)), SENT)
    second = runs.groupBy("bucket").applyInArrow(lean_table(_order_runs(threshold)), REPLY)
    replies = first.unionByName(second)
    return by_block.cogroup(replies.groupBy("block")).applyInArrow(lean_table(_remove(threshold, count, whole_chars)), RESULT)


def digest(result: DataFrame) -> DataFrame:
    """One row a document with the digest of what was kept."""
    return result.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def replace_texts(docs: DataFrame, threshold: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with what suffix_dedup keeps of their texts, whole characters only; n_chars, where there is one, is counted anew."""
    found = suffix_dedup(docs, threshold, id_col, text_col, whole_chars=True).where("n_removed > 0")
    changed = found.select(F.col("doc_id").alias("__doc"), F.col("source_sha256").alias("__sha"), F.col("kept").cast("string").alias("__kept")).dropDuplicates(["__doc", "__sha"])
    own = docs.withColumn("__own", F.sha2(F.col(text_col).cast("binary"), 256))
    joined = own.join(changed, (own[id_col].cast("long") == changed["__doc"]) & (own["__own"] == changed["__sha"]), "left")
    text = F.coalesce(F.col("__kept"), F.col(text_col))
    out = [text.alias(c) if c == text_col else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return joined.select(*out)
