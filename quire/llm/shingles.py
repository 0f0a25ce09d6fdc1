"""Word shingles of texts: maximal runs of characters other than ASCII white space, A-Z in lower case, joined by one space.

Repeats count; a text of fewer words than the width has one shingle, the whole sequence; one without words has none.
"""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def slices(body: np.ndarray, at: np.ndarray, width: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All words with one space after each, and for each shingle where it starts and ends there and the text that it is of."""
    docs = len(at) - 1
    low = _LOWER[body]
    word = ~_SPACE[low]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    begin, stop = at[:-1][at[:-1] < len(body)], at[1:][at[1:] > 0] - 1
    first[begin], last[stop] = word[begin], word[stop]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(start):
        none = np.zeros(0, np.int64)
        return b"", none, none, none
    # Words with one space after each: a shingle is a slice.
    gap = ~word
    gap[1:] &= word[:-1]
    gap[0] = False
    keep = word | gap
    flat = np.where(word, low, np.uint8(0x20))[keep].tobytes()
    place = np.cumsum(keep)
    doc = np.searchsorted(at, start, side="right") - 1
    count = np.bincount(doc, minlength=docs)
    shingles = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    base = np.cumsum(count) - count
    owner = np.repeat(np.arange(docs), shingles)
    lead = np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + base[owner]
    tail = lead + np.minimum(count[owner], width) - 1
    return flat, place[start[lead]] - 1, place[end[tail] - 1], owner


def shingles_of(body: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each shingle and the text that it is of, in order."""
    flat, a, b, owner = slices(body, at, width)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(flat[x:y], SEED) for x, y in zip(a.tolist(), b.tolist(), strict=True)), np.uint64, len(owner)), owner
