import random

import corpus_pipeline
import numpy as np

from quire.llm import near_copies as near_module
from quire.llm.near_copies import AGREE, NEAR, bands_for, candidates, component_classes, fingerprints, keep_first, shared_counts
from quire.llm.simhash import drop_near_copies

from .common import documents, texts
from .test_simhash import LOWER, union

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").translate(LOWER).split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {" ".join(w)}


def near_copies(seed, n):
    """Texts, with copies of them in which some words are changed."""
    rng, out = random.Random(seed), []
    for t in texts(seed, n):
        out.append(t)
        words = t.split()
        if len(words) > 20:
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = f"n{rng.random()}"
            out.append(" ".join(words))
    return out


def brute(rows):
    """The (doc_id, text) that stay: the smallest of each component of pairs with a Jaccard of 0.8 or more."""
    own = [(d, t or "") for d, t in rows if d is not None]
    sets = [shingles(t) for _, t in own]
    pairs = [(i, j) for j in range(len(own)) for i in range(j) if len(sets[i] & sets[j]) * 10 >= len(sets[i] | sets[j]) * 8]
    root = union(range(len(own)), pairs)
    least = {}
    for i, row in enumerate(own):
        least[root[i]] = min(row, least.get(root[i], row))
    return sorted(least.values()), len(pairs)


def test_stage_matches_brute_force(spark):
    rows = list(enumerate(near_copies(8, 150)))
    want, pairs = brute(rows)
    assert pairs > 40
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], SCHEMA).repartition(3)
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.simhash_near_dup(spark, docs, "").collect()) == want


def test_odd_rows_and_rows_that_share_an_id(spark):
    rows = [(d, t) for d, t in documents(4, 30) if d is None or d < 10_000]
    far = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(3)]
    rows += [(5001, far[0]), (5001, far[1]), (5002, far[0]), (5003, far[2]), (5003, far[2])]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA)
    got = [(r.doc_id, r.text or "") for r in corpus_pipeline.simhash_near_dup(spark, docs, "").collect()]
    assert {(5001, far[0]), (5001, far[1]), (5003, far[2])} <= set(got) and (5002, far[0]) not in got
    assert sorted(r for r in got if r[0] is not None) == brute(rows)[0]
    assert sum(d is None for d, _ in got) == 2


def test_large_groups_lose_no_link(spark):
    """Families that share most of their words, so that hundreds of classes meet under one key, with few real copies among them."""
    rng = random.Random(12)
    rows = []
    for family in range(3):
        stock = [f"s{family}x{i}" for i in range(100)]
        for k in range(120):
            own = [w if rng.random() > 0.04 else f"o{rng.random()}" for w in stock]
            rows.append((len(rows), " ".join(own)))
            if k % 10 == 0:
                own[rng.randrange(100)] = "changed"
                rows.append((len(rows), " ".join(own)))
    for k in range(200):  # one group of near copies
        words = [f"g{i}" for i in range(120)]
        words[rng.randrange(120)] = f"n{k}"
        rows.append((len(rows), " ".join(words)))
    want, _ = brute(rows)
    assert 100 < len(want) < len(rows) - 200
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], SCHEMA).repartition(4)
    for direct, block in ((32, 2048), (4, 50), (4, 7)):
        kept = keep_first(docs, component_classes(docs, direct=direct, block=block))
        assert sorted((r.doc_id, r.text) for r in kept.collect()) == want


def test_shared_counts():
    rng = np.random.default_rng(2)
    for rows, values in ((1, 5), (40, 60), (90, 300)):
        has = rng.random((rows, values)) < rng.random(values)[None, :]
        owner, at = np.nonzero(has)
        names = rng.integers(-(1 << 62), 1 << 62, values)
        counts = shared_counts(names[at], owner, rows)
        want = has.astype(int) @ has.T.astype(int)
        off = ~np.eye(rows, dtype=bool)
        assert np.array_equal(counts[off], want[off])


def test_clashing_columns_and_partitions(spark):
    rows = [(1, "a b c d e f", "x", "y", 3), (1, "a b c d e f", "w", "y", 4), (2, "A B c  d e f", "x", "z", 5), (3, None, "x", "z", 5), (4, " ", None, None, None)]
    results = set()
    for parts in (1, 2, 3):
        docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, root string, id long").repartition(parts)
        got = drop_near_copies(docs)
        assert got.columns == docs.columns
        results.add(tuple(sorted(map(tuple, got.collect()), key=str)))
    assert len(results) == 1 and [r[0] for r in results.pop()] == [1, 3]


def test_fingerprints_are_majorities():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 4, 5, 8, 9, 64, 301, 10_000):
        values = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        got = fingerprints(values, 5)
        own = np.concatenate([values[: 1 - len(values) % 2], values])
        for k in range(5):
            words = [int(fingerprints(v[None], 5)[k]) for v in own]
            assert int(got[k]) == sum(1 << bit for bit in range(64) if 2 * sum(w >> bit & 1 for w in words) > len(words))


def test_candidates_come_from_fingerprints(spark):
    """Sets at a Jaccard of 0.8 meet by the bands of their fingerprints; unrelated ones are not candidates.  Members of large groups are named."""
    rng = np.random.default_rng(6)
    bits, bands, prints = bands_for(400)
    sets = []
    for _ in range(200):
        values = rng.integers(0, 1 << 63, 90 + int(rng.integers(20))).astype(np.uint64)
        sets += [np.unique(values[len(values) // 10 :]), np.unique(values[: len(values) - len(values) // 10])]
    rows = [(i, fingerprints(v, prints).view(np.int64).tolist()) for i, v in enumerate(sets)]
    classes = spark.createDataFrame(rows, "digest long, prints array<long>")
    got = {(r.a, r.b) for r in candidates(classes, bits, bands).collect()}
    assert got == {(i, i + 1) for i in range(0, 400, 2)}
    same = classes.selectExpr("digest", f"(select first(prints) from values (array({', '.join(f'{x}L' for x in rows[0][1])})) t(prints)) as prints")
    for direct, held in ((8, 512), (1000, 100)):
        named = candidates(same, bits, bands, direct, held).select("kind", "b").distinct().collect()
        assert sorted(r.b for r in named) == list(range(400)) and {r.kind for r in named} == {2}


def test_fingerprints_miss_next_to_nothing(spark):
    assert all(1 - (1 - AGREE**bits) ** bands > 0.99998 for bits, bands, _ in map(bands_for, (1, 10**5, 10**7)))


def test_pairs_by_chance_get_no_set(spark):
    """Unrelated texts that are near in the first two fingerprints only are no pair any more; those at 0.8 stay, down to the smallest."""
    rng = np.random.default_rng(7)
    rows, pairs = [], []
    for i, n in enumerate([4, 4, 4, 4, 9, 90, 90, 2000] * 20):
        values = rng.integers(0, 1 << 63, n + n // 4).astype(np.uint64)
        a, b = fingerprints(np.unique(values[:n]), 16), fingerprints(np.unique(values), 16)
        if i % 2:
            b[2:] = rng.integers(0, 1 << 63, 14).astype(np.uint64)
        rows += [(2 * i, n, a.view(np.int64).tolist()), (2 * i + 1, n + n // 4, b.view(np.int64).tolist())]
        pairs.append((NEAR, 2 * i, 2 * i + 1))
    rows.append((999, 3, rows[0][2]))
    pairs.append((NEAR, 0, 999))  # equal fingerprints of sets of 3 and 4
    left = near_module._near(spark.createDataFrame(pairs, "kind int, a long, b long"), spark.createDataFrame(rows, "digest long, size int, prints array<long>"))
    assert sorted(r.a // 2 for r in left.collect()) == list(range(0, 160, 2))


def test_texts_sent_or_met_in_place_give_the_same(spark, monkeypatch):
    rows = list(enumerate(near_copies(9, 60)))
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in [*rows, *rows[:9], (None, rows[0][1])]], SCHEMA)
    want = sorted((r.doc_id, r.text) for r in drop_near_copies(docs).collect() if r.doc_id is not None)
    assert want == brute(rows)[0]
    monkeypatch.setattr(near_module, "BROADCAST_KEYS", 0)
    assert sorted((r.doc_id, r.text) for r in drop_near_copies(docs).collect() if r.doc_id is not None) == want


def test_pairs_grow_with_a_group_not_with_its_square(spark):
    """Groups of near classes: under the limit of pairs that a run has by itself, twice the classes don't make four times the pairs; no class is left out."""
    rng = np.random.default_rng(8)
    bits, bands, prints = bands_for(100)
    made = []
    for n in (30, 60):
        stock = rng.integers(0, 1 << 63, 200).astype(np.uint64)
        rows = [(i, fingerprints(np.unique(np.append(stock, np.uint64(i))), prints).view(np.int64).tolist()) for i in range(n)]
        got = candidates(spark.createDataFrame(rows, "digest long, prints array<long>"), bits, bands).distinct().collect()
        made.append(len({(r.a, r.b) for r in got if r.kind < 2}))
        assert {r.b for r in got} == set(range(n))
    assert made[1] <= max(4 * 60, 2 * made[0])
