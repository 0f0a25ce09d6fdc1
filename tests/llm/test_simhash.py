import random
import re

import numpy as np
import pytest
import xxhash

from quire.llm.graph import components
from quire.llm.simhash import keep_one, link, near_duplicates

from .common import SCHEMA, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_matches_brute_force(spark):
    rows = documents(11, 150)
    prints = [(d, fingerprint(t)) for d, t in rows]
    distinct = sorted({p for _, p in prints})
    root = union(distinct, [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 2])
    least: dict = {}
    for d, p in prints:
        if d is not None:
            least[root[p]] = min(d, least.get(root[p], d))
    want = sorted(((d, f"{p:016x}", least.get(root[p])) for d, p in prints), key=str)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = near_duplicates(df)
    assert sorted(map(tuple, found.collect()), key=str) == want
    kept = sorted(r.doc_id for r in keep_one(df, found).collect() if r.doc_id is not None)
    assert kept == sorted(set(least.values()))


@pytest.mark.parametrize(("direct", "limit"), [(256, 1 << 17), (2, 1 << 17), (2, 5), (1, 1)])
def test_links_keep_all_components(spark, direct, limit):
    rng = random.Random(direct * 7 + limit)
    values = set()
    for _ in range(6):
        v = rng.getrandbits(64)
        for _ in range(25):
            values.add(v)
            v ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                v ^= 1 << rng.randrange(64)
            if rng.random() < 0.2:
                v ^= 7 << rng.randrange(60)
    values = sorted(values)
    want = union(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2])
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    links = link(spark.createDataFrame([(v,) for v in signed], "print long"), 2, direct, limit)
    root = {r.node: r.root for r in components(links).collect()}
    groups: dict = {}
    for v, s in zip(values, signed):
        groups.setdefault(root.get(s, s), set()).add(v)
    expected: dict = {}
    for v, r in want.items():
        expected.setdefault(r, set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


@pytest.mark.parametrize("local", [0, 1 << 18])
def test_components_of_a_long_path(spark, monkeypatch, local):
    """By one task, and by rounds over all links."""
    monkeypatch.setattr("quire.llm.graph.LOCAL_LINKS", local)
    edges = [(i, i + 1) for i in range(200)] + [(900, 901), (901, 901)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 900: 900, 901: 900}


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_keep_one_decides_by_row(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(3, b, "x", 1), (5, a, "y", 2), (5, b, "z", 3), (7, a, "w", 4), (7, a, "v", 5), (None, a, "u", 6)]
    results = set()
    for parts in (1, 2, 3):
        df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, component_id long").repartition(parts)
        got = keep_one(df, near_duplicates(df))
        assert got.columns == df.columns
        results.add(tuple(sorted(map(tuple, got.collect()), key=str)))
    assert results == {((3, b, "x", 1), (5, a, "y", 2), (None, a, "u", 6))}


def test_keep_one_keeps_a_text_of_each_component(spark):
    rows = documents(17, 120)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = near_duplicates(df).collect()
    component = {(r.doc_id, r.fingerprint): r.component_id for r in found}
    kept = [(r.doc_id, r.text) for r in keep_one(df, near_duplicates(df)).collect() if r.doc_id is not None]
    classes = [component[d, f"{fingerprint(t):016x}"] for d, t in kept]
    assert sorted(classes) == sorted({c for (d, _), c in component.items() if d is not None}) and all(d == c for (d, _), c in zip(kept, classes, strict=True))
