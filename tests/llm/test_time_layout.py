import hashlib
import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta
from pathlib import Path
from urllib.parse import urlparse

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quire.llm.queries import op11_adaptive_time_partitions
from quire.llm.time_layout import Layout, digest, fold_years, runs, year_plan

SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
CUTOFF = datetime(2024, 4, 1)
COLUMNS = "click_id,ts,arrived_at,client_id,kind,value,props"


def moment(click_id, ts):
    if ts is None or click_id is None:
        return ts
    k = zlib.crc32(str(click_id).encode()) % 128
    if k < 16:
        return ts - timedelta(days=(k + 6) ** 3)
    if k > 111:
        return (ts - timedelta(days=ts.weekday())).replace(hour=0, minute=0, second=0, microsecond=0)
    return ts


def children(node):
    """The names of all children of a node, a tuple of year, month, day; () has none of its own."""
    if len(node) == 1:
        return [(*node, m) for m in range(1, 13)]
    if len(node) == 2:
        first = datetime(*node, 1)
        after = datetime(node[0] + node[1] // 12, node[1] % 12 + 1, 1)
        return [(*node, d) for d in range(1, (after - first).days + 1)]
    return [(*node, h) for h in range(24)]


def brute_layout(rows, limit, own_moment=moment):
    """{(leaf, part): rows in order}; the tree is built node by node from sorted rows."""
    key = lambda r: tuple((v is not None, v) for v in (own_moment(r[0], r[1]), r[2], r[0]))
    held = defaultdict(list)
    out = {}
    for r in rows:
        m = own_moment(r[0], r[1])
        path = (m.year, m.month, m.day, m.hour) if m else None
        for depth in range(1, 5) if m else ():
            held[path[:depth]].append(r)
        if m is None:
            held[None].append(r)

    def leaf(name, own):
        own = sorted(own, key=key)
        for p in range(0, len(own), limit):
            out[name, p // limit + 1] = own[p : p + limit]

    def label(parents, a, b):
        text = lambda v, depth: f"{v:04d}" if depth == 0 else f"{v:02d}"
        return "/".join([*(text(v, i) for i, v in enumerate(parents)), f"{text(a, len(parents))}-{text(b, len(parents))}"])

    def siblings(nodes):
        i = 0
        while i < len(nodes):
            own = held[nodes[i]]
            if len(own) > limit:
                if len(nodes[i]) == 4:
                    leaf(label(nodes[i][:-1], nodes[i][-1], nodes[i][-1]), own)
                else:
                    siblings(children(nodes[i]))
                i += 1
                continue
            j, total = i, list(own)
            while j + 1 < len(nodes) and len(held[nodes[j + 1]]) <= limit and len(total) + len(held[nodes[j + 1]]) <= limit:
                j += 1
                total += held[nodes[j]]
            if total:
                leaf(label(nodes[i][:-1], nodes[i][-1], nodes[j][-1]), total)
            i = j + 1

    years = sorted(k[0] for k in held if k and len(k) == 1)
    if years:
        siblings([(y,) for y in range(years[0], years[-1] + 1)])
    if held[None]:
        leaf("null", held[None])
    return out


def want(rows, limit):
    fresh = lambda r: r[2] is None or r[2] >= CUTOFF
    start, final = brute_layout([r for r in rows if not fresh(r)], limit), brute_layout(rows, limit)
    out = {}
    for place, own in final.items():
        ids = ",".join("" if r[0] is None else str(r[0]) for r in own)
        stays = sorted(start.get(place, []), key=str) == sorted(own, key=str)
        out[place] = (len(own), sum(map(fresh, own)), hashlib.sha256(ids.encode()).hexdigest(), not stays)
    return out


def clicks(seed, n, hot=0.0, odd=True):
    rng, out = random.Random(seed), []
    for i in range(n):
        ts = datetime(2024, 1, 1) + timedelta(seconds=rng.randint(0, 120 * 86400)) if rng.random() > hot else datetime(2024, 2, 5, 7, rng.randint(0, 2))
        out.append((i, ts, ts + timedelta(seconds=rng.randint(0, 90_000)), rng.randint(0, 9), rng.choice(["a", "b", None]), float(i % 7), None))
    out += [rng.choice(out) for _ in range(n // 20)]  # repeats
    if odd:
        out += [(n + i, None, datetime(2024, 1 + i % 4, 2), 1, None, None, None) for i in range(n // 60)]
        out += [(None, datetime(2024, 2, 3, 4), None, 1, None, None, None), (None, None, None, None, None, None, None)]
    rng.shuffle(out)
    return out


def check(got, rows, limit, columns=COLUMNS):
    expected = want(rows, limit)
    assert {(r.leaf, r.part): (r.n_rows, r.n_new, r.ids_sha256, r.rewritten) for r in got} == expected
    assert len(got) == len(expected) and {r.columns for r in got} <= {columns}
    for r in got:  # the files themselves
        stored = pq.read_table(urlparse(r.path).path, partitioning=None)
        assert ",".join(stored.column_names) == r.columns
        ids = ",".join("" if v is None else str(v) for v in stored.column("click_id").to_pylist())
        assert hashlib.sha256(ids.encode()).hexdigest() == r.ids_sha256
    if got:
        root = Path(urlparse(got[0].path).path).parents[2]
        assert {str(f) for f in root.rglob("*.parquet")} == {urlparse(r.path).path for r in got}
    return expected


@pytest.mark.parametrize(("seed", "n", "hot"), [(1, 3000, 0.0), (2, 1700, 0.4), (3, 30, 0.0)])
def test_query_matches_brute_force(spark, tmp_path, seed, n, hot):
    rows = clicks(seed, n, hot)
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/clicks.parquet")
    expected = check(op11_adaptive_time_partitions(spark, str(tmp_path)).collect(), rows, 1 + len(rows) // 800)
    if n > 1000:
        assert {True, False} == {v[3] for v in expected.values()} and max(p for _, p in expected) > 3


def lay_out(spark, rows, limit, folder, schema=SCHEMA):
    table = spark.createDataFrame(rows, schema).repartition(3)
    fresh = lambda c: c.isNull() | (c >= F.lit(str(CUTOFF)).cast("timestamp_ntz"))
    layout = Layout(f"file://{folder}/out", F.col("ts"), ["arrived_at", "click_id"], limit)
    layout.write(table.where(~fresh(F.col("arrived_at"))))
    stayed = layout.rewrite(table, fresh(F.col("arrived_at")))
    return digest(layout, spark, table.schema, stayed, "click_id", fresh(F.col("row.arrived_at"))).collect()


def test_parts_ahead_of_the_first_new_row_stay(spark, tmp_path, monkeypatch):
    """An hour of several parts; and one whose rows are all equal, so that parts recur behind a new row too."""
    hour, late = datetime(2024, 2, 5, 7), datetime(2024, 4, 2)
    old = [(i, hour + timedelta(seconds=i), datetime(2024, 2, 6), 1, "a", 1.0, None) for i in range(100)]
    equal = [(7, datetime(2024, 3, 5, 9, 5), datetime(2024, 3, 6), 1, "a", 1.0, None)] * 90
    new = [(500, hour + timedelta(seconds=55), late, 1, "a", 1.0, None), (1, datetime(2024, 3, 5, 9, 1), late, 1, "b", 2.0, None)]
    monkeypatch.setitem(globals(), "moment", lambda _, ts: ts)
    expected = check_plain(lay_out(spark, old + equal + new, 10, tmp_path), old + equal + new, 10)
    stays = {k for k, v in expected.items() if not v[3]}
    assert {p for leaf, p in stays if leaf.startswith("2024/02/05")} == {1, 2, 3, 4, 5}
    assert {p for leaf, p in stays if leaf.startswith("2024/03/05")} == set(range(2, 10))


def check_plain(got, rows, limit):
    plain = lambda _, ts: ts
    fresh = lambda r: r[2] is None or r[2] >= CUTOFF
    start, final = brute_layout([r for r in rows if not fresh(r)], limit, plain), brute_layout(rows, limit, plain)
    expected = {}
    for place, own in final.items():
        ids = ",".join("" if r[0] is None else str(r[0]) for r in own)
        expected[place] = (len(own), sum(map(fresh, own)), hashlib.sha256(ids.encode()).hexdigest(), sorted(start.get(place, []), key=str) != sorted(own, key=str))
    assert {(r.leaf, r.part): (r.n_rows, r.n_new, r.ids_sha256, r.rewritten) for r in got} == expected
    return expected


def test_random_spans_of_years(spark, tmp_path):
    rng = random.Random(5)
    for case in range(2):
        rows = []
        for i in range(400):
            ts = datetime(rng.choice([1960, 1961, 1999, 2000, 2004, 2016]), rng.choice([1, 2, 12]), rng.randint(1, 28), rng.randint(0, 23)) if rng.random() < 0.97 else None
            rows.append((i, ts, datetime(2024, rng.choice([1, 2, 3, 5]), 1), 1, None, None, None))
        check_plain(lay_out(spark, rows, [7, 90][case], tmp_path / str(case)), rows, [7, 90][case])


def test_empty_table_and_clashing_columns(spark, tmp_path):
    assert lay_out(spark, [], 1, tmp_path / "none") == []
    schema = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, leaf string, Part int, row int, m int, `year` int, slot int, `a.b` string, _metadata int, tags map<string, int>"
    rows = [(i, datetime(2024, 1 + i % 3, 3), datetime(2024, 1 + i % 5, 4), "x", 1, 2, 3, 4, 5, "d", 7, {"k": i}) for i in range(40)]
    got = lay_out(spark, rows, 8, tmp_path / "clash", schema)
    check_plain(got, rows, 8)
    assert {r.columns for r in got} == {"click_id,ts,arrived_at,leaf,Part,row,m,year,slot,a.b,_metadata,tags"}


def test_plan_by_hand():
    assert runs([1, 5, 0, 3, 9, 0, 2], 5) == [[0, 0, 1], [1, 2, 5], [3, 3, 3], [4, 4, 9], [5, 6, 2]]
    assert fold_years({2000: 1, 2003: 1, 2004: 9, 2007: 2, 2008: 4}, 5) == {2000: "2000-2003", 2003: "2000-2003", 2007: "2005-2007", 2008: "2008-2008"}
    import numpy as np

    hours = np.zeros(366 * 24, np.int64)
    hours[[0, 30, 31 * 24]] = [4, 3, 2]
    names = year_plan(2024, hours, 5)
    assert names[0] == "2024/01/01-01" and names[30] == "2024/01/02-31" and names[31 * 24] == "2024/02-12"
