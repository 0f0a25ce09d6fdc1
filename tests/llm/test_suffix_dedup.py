import hashlib
import random

import pytest

from pyspark.sql import functions as F

from quire.llm.blocks import block_id, spark_hash
from quire.llm.suffix_dedup import digest, suffix_dedup


def brute(rows, threshold):
    out = []
    texts = [(d, (t or "").encode()) for d, t in rows]
    first: dict[bytes, int] = {}
    for d, t in texts:
        if d is None:
            continue
        for i in range(len(t) - threshold + 1):
            w = t[i : i + threshold]
            if w not in first or d < first[w]:
                first[w] = d
    for d, t in texts:
        gone = [False] * len(t)
        if d is not None:
            for i in range(len(t) - threshold + 1):
                if first[t[i : i + threshold]] < d:
                    gone[i : i + threshold] = [True] * threshold
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["the", "añb", "of", "q", "xyz", "longer-word", "ö", "and", "\n"]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 40))) for _ in range(12)]
    rows = []
    for d in range(n):
        k = rng.random()
        if rows and k < 0.2:
            text = rows[rng.randrange(len(rows))][1]
        elif rows and k < 0.4:
            t = rows[rng.randrange(len(rows))][1] or ""
            i = rng.randint(0, len(t))
            text = t[:i] + rng.choice(["", "!", "é"]) + t[i + rng.randint(0, 2) :]
        else:
            text = " ".join(rng.choice([*lines, "".join(rng.choice("abcdef ") for _ in range(60))]) for _ in range(rng.randint(0, 6)))
        rows.append((d * 3 % 97 + d, text))
    return rows


@pytest.mark.parametrize("threshold", [50, 12, 8, 5])
def test_matches_brute_force(spark, threshold):
    rows = [*corpus(threshold, 70), (500, None), (501, ""), (502, "a" * 400), (503, "b" + "a" * 300), (503, "a" * 120), (None, "a" * 200), (504, "ab" * 300), (505, "ba" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, digest(suffix_dedup(df, threshold)).collect()), key=str)
    assert got == brute(rows, threshold)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup(df).collect() == []
    df = spark.createDataFrame([(1, "x" * 60, 5, "b"), (2, "x" * 60, 6, "c")], "doc_id long, text string, block long, kept string")
    assert {(r.doc_id, r.n_removed) for r in suffix_dedup(df).collect()} == {(1, 0), (2, 60)}


def test_whole_characters_stay_valid(spark):
    rows = [(1, "é" * 40 + "x"), (2, "a" + "é" * 40), (3, "ñ" + "é" * 25 + "ê")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for row in suffix_dedup(df, 21, whole_chars=True).collect():
        bytes(row.kept).decode()


def test_blocks_are_dealt_evenly(spark):
    values = [0, 1, -1, 7 << 40, (3 << 36) + (5 << 20), -(1 << 63), (1 << 63) - 1]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", F.hash("v").alias("h")).collect()
    assert [spark_hash(r.v) for r in rows] == [r.h for r in rows]
    for buckets in (1, 4, 51):
        dealt = [spark_hash(block_id(part, seq, buckets)) % buckets for part in range(6) for seq in range(40)]
        counts = [dealt.count(b) for b in range(buckets)]
        assert max(counts) - min(counts) <= 6 and len({block_id(p, s, buckets) for p in range(6) for s in range(40)}) == 240
