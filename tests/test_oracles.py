"""Every registered query that has SQL, held against it on the driver's smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from quire.plans import QUERIES, SQL

FOLDER = os.environ.get("QUIRE_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="the driver's tables aren't there")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for file in sorted(Path(FOLDER).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if hasattr(value, "quantize"):
        return round(float(value), 6)
    return tuple(map(plain, value)) if isinstance(value, list) else value


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, tables, name):
    found = QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    said = tables.execute(SQL[name])
    names = [d[0] for d in said.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in said.fetchall()), key=str)
    assert sorted((tuple(plain(row[c]) for c in columns) for row in found.collect()), key=str) == want


def test_every_query_with_sql_is_registered():
    assert set(SQL) <= set(QUERIES)
