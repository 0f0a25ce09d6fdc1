import numpy as np
import pytest

from quire.llm.ann import nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, k):
    good = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v) or len(v) != 16:
            continue
        good.setdefault(i, []).append(np.array(v, np.float32).astype(float))
    out = {}
    for q, own in good.items():
        if q % every:
            continue
        a = own[0]
        near = sorted((-float(a @ v / np.sqrt((a @ a) * (v @ v))), i) for i, vs in good.items() if i != q for v in vs[:1])
        out[q] = [(i, -s) for s, i in near[:k]]
    return out


def table(n, seed, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, 16))
    vs = centres[rng.integers(0, 12, n)] + 0.6 * rng.standard_normal((n, 16))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vs)]
    rows += [(n + i, rows[0][1]) for i in range(copies)]
    return rows


def test_exhaustive_matches_brute_force(spark):
    rows = table(300, 1, 70) + [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16), (1150, [None, *[1.0] * 15]), (1200, [1.0]), (1250, []), (None, [1.0] * 16), (1300, [2.0] * 16), (1350, [1.0] * 16)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    got: dict = {}
    for r in sorted(nearest_neighbours(df, strictness=50.0).collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(got.setdefault(r.query_id, [])) + 1
        got[r.query_id].append((r.vec_id, r.score))
    want = brute(rows, 50, 5)
    assert got.keys() == want.keys()
    for q, near in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in near], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in near], atol=1e-12)


def test_recall_with_lists(spark):
    rows = table(3000, 2)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = nearest_neighbours(df, exact_rows=500).collect()
    want = brute(rows, 50, 5)
    hits = sum((r.vec_id in [i for i, _ in want[r.query_id]]) for r in got)
    assert len(got) == 5 * len(want) and hits / len(got) >= 0.9


@pytest.mark.parametrize("rows", [[], [(0, None)], [(0, [1.0, 2.0])], [(0, [1.0, 2.0]), (1, [2.0, 1.0])]])
def test_small_tables(spark, rows):
    got = nearest_neighbours(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == ([(0, 1, 1)] if len(rows) == 2 else [])


def test_recall_on_the_tables_of_the_driver(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()]
    known = np.array([v for _, v in rows], float)
    known /= np.sqrt((known * known).sum(axis=1, keepdims=True))
    ids = np.array([i for i, _ in rows])
    got = {}
    for r in nearest_neighbours(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        score = known @ known[q]
        near = [int(ids[j]) for j in np.lexsort((ids, -score)) if ids[j] != ids[q]][:5]
        total += len(near)
        hits += len(got[int(ids[q])] & set(near))
    assert len(rows) > 400 and hits / total >= 0.9


def test_every_length_and_all_digits_of_doubles(spark):
    rows = [(0, [1e200, 1.0, 0.0]), (1, [1.0, 1e-9, 0.0]), (2, [1.0, 2e-9, 0.0]), (3, [0.0, 1e-300, 0.0]), (50, [1.0, 0.0]), (51, [0.5, 0.5]), (52, [1.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in nearest_neighbours(df).collect()}
    assert [got[0, k][0] for k in (1, 2, 3)] == [1, 2, 3] and [got[50, k][0] for k in (1, 2)] == [52, 51]
    assert len(got) == 5 and abs(got[50, 2][1] - 0.5**0.5) < 1e-15


def test_clashing_columns(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(8).astype(np.float32)], "x", 1.0, i) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node string, score double, query long")
    assert nearest_neighbours(df).columns == ["query_id", "rank", "vec_id", "score"] and nearest_neighbours(df).count() == 18 * 5
