import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quire.llm.packing import _best_pair, _Counts, best_fit, pack, reduce_instance, solve

from .common import SCHEMA, documents


def used(patterns):
    c = Counter()
    for pattern, times in patterns:
        for length, n in pattern:
            c[length] += n * times
    return c


def sequences(patterns):
    return sum(t for _, t in patterns)


def one_by_one(counts, capacity):
    rooms = []
    for w in sorted(Counter(counts).elements(), reverse=True):
        fit = [r for r in rooms if r >= w]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - w)
        else:
            rooms.append(capacity - w)
    return len(rooms)


def optimum(items, capacity):
    items = tuple(sorted(items, reverse=True))
    best = len(items)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms)}.values():
            if rooms[k] >= items[i]:
                go(i + 1, (*rooms[:k], rooms[k] - items[i], *rooms[k + 1 :]))
        go(i + 1, (*rooms, capacity - items[i]))

    go(0, ())
    return best


@pytest.mark.parametrize("seed", range(40))
def test_counts_pack_like_single_pieces(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 31, 100])
    counts = {rng.randint(1, capacity): rng.randint(1, 30) for _ in range(rng.randint(0, 25))}
    plain = best_fit(counts, capacity)
    assert used(plain) == Counter(counts) and sequences(plain) == one_by_one(counts, capacity)
    packed = solve(counts, capacity)
    assert used(packed) == Counter(counts)
    assert all(sum(n * w for w, n in p) <= capacity for p, _ in packed)


@pytest.mark.parametrize("seed", range(60))
def test_reduction_costs_nothing(seed):
    rng = random.Random(seed)
    items = [rng.randint(rng.choice([1, 4]), 20) for _ in range(rng.randint(1, 10))]
    fixed, left = reduce_instance(Counter(items), 20)
    assert used(fixed) + Counter(left) == Counter(items)
    assert sequences(fixed) + optimum(list(Counter(left).elements()), 20) == optimum(items, 20)


def test_best_pair():
    assert _best_pair(_Counts({3: 1, 5: 2, 9: 1}), 10, ()) == 10
    assert _best_pair(_Counts({3: 1, 5: 1, 9: 1}), 10, ()) == 8
    assert _best_pair(_Counts({5: 2}), 10, (5,)) == 0


def check(rows, got, capacity):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want.append((d, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(by) == sequences(solve(Counter(r.length for r in got), capacity))


@pytest.mark.parametrize("capacity", [2048, 30])
def test_packs_documents(spark, capacity):
    rows = documents(9, 120)
    check(rows, pack(spark.createDataFrame(rows, SCHEMA).repartition(3), "word_bpe_49k.json", 0, capacity).collect(), capacity)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], SCHEMA), "word_bpe_49k.json").collect() == []


@pytest.mark.parametrize("seed", range(8))
def test_few_sequences_against_the_sum_of_lengths(seed):
    """No packing has fewer sequences than the sum of lengths over the capacity; many mixed lengths come close to it."""
    rng = random.Random(seed)
    counts = Counter(min(2048, max(1, int(rng.lognormvariate(5.5, 1.2)))) for _ in range(20_000))
    least = -(-sum(n * w for w, n in counts.items()) // 2048)
    assert least <= sequences(solve(dict(counts), 2048)) <= least + 2
