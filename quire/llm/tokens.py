"""Token ids of many texts at once, exactly as the tokenizers library gives them.

A corpus repeats its words, so a word goes to the library once for a worker and its ids are looked up afterwards.  Most texts
are split into words with numpy over their bytes; any text with a character whose normalising or splitting could
depend on its neighbours goes to the library whole.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa

from quire.llm.blocks import byte_ranges, mix, text_bytes

#: Words a worker remembers (under 100 MB), and bytes of text that it splits at once.
MEMO_LIMIT = 400_000
_BATCH_BYTES = 1 << 20
_SPACE, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3


def _tables() -> tuple[np.ndarray, np.ndarray]:
    kind, lower = np.full(256, _OTHER, np.uint8), np.arange(256, dtype=np.uint8)
    kind[[9, 10, 11, 12, 13, 32]] = _SPACE
    for first, last in (("a", "z"), ("A", "Z")):
        kind[ord(first) : ord(last) + 1] = _LETTER
    kind[ord("0") : ord("9") + 1] = _DIGIT
    kind[0x80:] = _LETTER
    lower[ord("A") : ord("Z") + 1] += 32
    return kind, lower


_KIND, _LOWER = _tables()
_POWERS = mix(np.arange(1, 1025, dtype=np.uint64))
#: Bytes as a byte-level vocabulary spells them: the printable ones of Latin-1 as themselves, the others from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPELL = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class Encoder:
    """Encodes with a tokenizer file, add_special_tokens=False.

    whole=True sends every text to the library whole.  The word path is only for a tokenizer of the file's kind: lower case,
    white space dropped, letters, single digits and other characters apart, byte-level pieces; `fits` tells.
    """

    def __init__(self, path: str, whole: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[bytes, bytes] = {}
        self.whole = whole or not self.fits()

    def fits(self) -> bool:
        norm, pre = str(self.tokenizer.normalizer), str(self.tokenizer.pre_tokenizer)
        split = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
        return norm == r'Sequence(normalizers=[NFC(), Replace(pattern=Regex("\s+"), content=" "), Lowercase()])' and f'Split(pattern=Regex("{split}"), behavior=Removed, invert=True), ByteLevel(add_prefix_space=False' in pre

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _piece(self, piece: bytes) -> bytes:
        """The ids of a word, as little-endian 32-bit integers."""
        ids = self.memo.get(piece)
        if ids is None:
            word = piece.decode() if piece.isascii() else piece.decode("latin-1")
            tokens = self.tokenizer.model.tokenize(word.translate(_SPELL))
            if len(self.memo) >= MEMO_LIMIT:
                self.memo.clear()
            ids = self.memo[piece] = array("I", [t.id for t in tokens]).tobytes()
        return ids

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null as empty) one after the other, and where each text's ids start."""
        body, at = text_bytes(texts)
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for lo, hi in byte_ranges(at, _BATCH_BYTES):
            got, n = self._batch(body[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            ids.append(got)
            counts.append(n)
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)

    def _batch(self, body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        docs = len(at) - 1
        slow = np.ones(docs, bool) if self.whole else self._odd(body, at)
        quick, n = self._words(body, at, slow)
        if not slow.any():
            return quick, n
        raw, start = body.tobytes(), np.concatenate([[0], np.cumsum(n)])
        parts = []
        for d in range(docs):
            if slow[d]:
                ids = self.encode(raw[at[d] : at[d + 1]].decode(errors="replace"))
                n[d] = len(ids)
                parts.append(ids)
            else:
                parts.append(quick[start[d] : start[d + 1]])
        return np.concatenate(parts), n

    @staticmethod
    def _odd(body: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Texts with an apostrophe, a separator control, a possible special token, or anything beyond ASCII and Latin-1 letters."""
        before = np.concatenate([[0], body[:-1]]).astype(np.uint8)
        after_c3 = before == 0xC3
        odd = (body == 0x27) | ((body >= 0x1C) & (body <= 0x1F)) | ((body == 0x7C) & (before == 0x3C))
        odd |= (body >= 0x80) & (body != 0xC3) & ~after_c3
        odd |= after_c3 & ((body == 0x97) | (body == 0xB7))
        out = np.zeros(len(at) - 1, bool)
        if where := np.flatnonzero(odd).tolist():
            out[np.searchsorted(at, where, side="right") - 1] = True
        return out

    def _words(self, body: np.ndarray, at: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        docs, size = len(at) - 1, len(body)
        none = np.zeros(0, np.uint32), np.zeros(docs, np.int64)
        if not size or skip.all():
            return none
        kind = _KIND[body]
        if skip.any():
            kind[np.repeat(skip, np.diff(at))] = _SPACE
        low = _LOWER[body]
        upper = (body[:-1] == 0xC3) & (body[1:] >= 0x80) & (body[1:] <= 0x9E)
        low[1:][upper] += 32
        edge = np.ones(size, bool)
        edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        edge[at[:-1][at[:-1] < size]] = True
        starts = np.flatnonzero(edge)
        lens = np.diff(np.append(starts, size))
        real = kind[starts] != _SPACE
        pos = np.arange(size) - np.repeat(starts, lens)
        sums = np.add.reduceat((low.astype(np.uint64) + np.uint64(1)) * _POWERS[pos & 1023], starts)
        starts, lens, sums = starts[real], lens[real], sums[real]
        if not len(starts):
            return none
        _, first, which = np.unique(sums + mix(lens.astype(np.uint64)), return_index=True, return_inverse=True)
        # Sums only find the candidates; pieces count as one only if their bytes are equal.
        rep = starts[first][which]
        if not np.array_equal(lens, lens[first][which]):
            return self._plain(low, starts, lens, at)
        total = np.concatenate([[0], np.cumsum(lens)])
        inside = np.arange(total[-1]) - np.repeat(total[:-1], lens)
        if not np.array_equal(low[np.repeat(starts, lens) + inside], low[np.repeat(rep, lens) + inside]):
            return self._plain(low, starts, lens, at)
        raw = low.tobytes()
        pieces = [self._piece(raw[a : a + n]) for a, n in zip(starts[first].tolist(), lens[first].tolist(), strict=True)]
        size_of = np.array([len(p) for p in pieces], np.int64) // 4
        begin = np.concatenate([[0], np.cumsum(size_of)])[:-1]
        known = np.frombuffer(b"".join(pieces), np.uint32)
        n = size_of[which]
        out_at = np.concatenate([[0], np.cumsum(n)])
        ids = known[np.arange(out_at[-1]) + np.repeat(begin[which] - out_at[:-1], n)]
        return ids, np.diff(out_at[np.searchsorted(starts, at)])

    def _plain(self, low: np.ndarray, starts: np.ndarray, lens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = low.tobytes()
        pieces = [self._piece(raw[a : a + n]) for a, n in zip(starts.tolist(), lens.tolist(), strict=True)]
        out_at = np.concatenate([[0], np.cumsum([len(p) // 4 for p in pieces])]).astype(np.int64)
        return np.frombuffer(b"".join(pieces), np.uint32), np.diff(out_at[np.searchsorted(starts, at)])


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, whole: bool = False) -> Encoder:
    """This worker's encoder for a file; it keeps what it has looked up."""
    key = (path, whole)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, whole)
    return _ENCODERS[key]


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies on this machine; called on the worker that opens it."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def with_end(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same documents, each with end_id after its ids."""
    docs = len(at) - 1
    new_at = at + np.arange(docs + 1)
    out = np.full(int(new_at[-1]), end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[new_at[1:] - 1] = False
    out[keep] = ids
    return out, new_at
