import datetime as dt

import pytest
from pyspark.sql import functions as F

from quire import schemas
from quire.operators import series as S

NOW = dt.datetime(2026, 8, 7, 12)


def points(spark, rows):
    return spark.createDataFrame([(i, k, k, NOW, p, u, m) for i, k, p, u, m in rows], schemas.POINTS)


def state(df):
    return sorted((r.id, r.clave, r.precio, r.url, r.mensaje_id) for r in df.collect())


def test_series_group_by_folded_title(spark):
    df = spark.createDataFrame([("PLUTARCO -  Vidas II", 40.0, 1), ("Plutarco - vidas ii", 20.0, 2)], "titulo string, precio double, id long").withColumn("clave", S.series_key(F.col("titulo"))).withColumn("fecha", F.lit(NOW))
    row = S.series_stats(df).collect()
    assert [(r.n, r.primero, r.ultimo) for r in row] == [(2, 40.0, 20.0)]


def test_adoption(spark):
    first = points(spark, [(1, "k", 30.0, "u", None), (2, "k", 30.0, "u", None)])
    once = S.add_points(first, points(spark, [(3, "k", 30.0, "u", "m1")]))
    assert state(once) == [(1, "k", 30.0, "u", "m1"), (2, "k", 30.0, "u", None)]
    twice = S.add_points(once, points(spark, [(4, "k", 30.0, "u", "m1"), (5, "k", 22.0, "u", "m2"), (6, "k", 30.0, "u", "m3"), (7, "k", 1.0, None, None)]))
    assert state(twice) == [(1, "k", 30.0, "u", "m1"), (2, "k", 30.0, "u", "m3"), (5, "k", 22.0, "u", "m2"), (7, "k", 1.0, None, None)]


def test_rotation(spark):
    rows = spark.range(1, 1002).select("id", F.concat(F.lit("Libro "), (F.col("id") - 1).cast("string")).alias("titulo"))
    left = S.rotated(rows)
    assert left.count() == 501 and left.agg(F.min("id")).collect()[0][0] == 501
    assert S.rotated(rows.where("id <= 1000")).count() == 1000


def test_thresholds(spark):
    rows = spark.createDataFrame([("gredos", 50.0, 1), (" vidas paralelas ", 30.0, 2), ("vidas paralelas", 25.0, 3), ("  ", 1.0, 4)], "patron string, porcentaje double, seq int")
    table = S.set_thresholds(rows)
    assert table.count() == 2
    titles = spark.createDataFrame([("Plutarco - VIDAS PARALELAS - Gredos",), ("otro",)], "titulo string")
    assert {r.titulo: r.porcentaje for r in S.thresholds_for(titles, table).collect()} == {"Plutarco - VIDAS PARALELAS - Gredos": 25.0, "otro": None}


def test_watch_and_sold(spark):
    links = spark.createDataFrame([("1", "https://s/a~x1234567", 30.0, False)], schemas.LINKS)
    batch = spark.createDataFrame([("1", "https://s/a~x1234567?utm=1", 25.0, 1), ("1", "https://s/b?c", 9.0, 2), ("1", "", 3.0, 3), ("1", None, 3.0, 4)], "numero string, url string, precio double, seq long")
    out = S.watch(links, batch)
    assert sorted((r.url, r.ultimo_precio) for r in out.collect()) == [("https://s/a~x1234567", 25.0), ("https://s/b", 9.0)]
    rows = points(spark, [(1, "k", 30.0, "https://s/v?x", None), (2, "k", 25.0, "https://s/o", None), (3, "j", 30.0, "https://s/v", None)])
    left = S.retract_points(rows, spark.createDataFrame([("k", "https://s/v/#f")], "clave string, url string"))
    assert [r[0] for r in state(left)] == [2, 3]


def test_lots(spark):
    rows = points(spark, [(1, "lote::a", 1.0, None, None), (2, "b", 2.0, None, None)])
    lots = spark.createDataFrame([("Á", "u1", None, False), ("a", "u2", None, False), ("c", "u3", None, False)], schemas.LOTS)
    moved, named = S.rename_lot(rows, lots, "lote::a", "Nuevo")
    assert [r[1] for r in state(moved)] == ["lote::nuevo", "b"] and sorted(r.titulo for r in named.collect()) == ["Nuevo", "Nuevo", "c"]
    with pytest.raises(ValueError):
        S.rename_lot(rows, lots, "b", "x")
    gone, left = S.delete_lot(rows, lots, "lote::a")
    assert [r[0] for r in state(gone)] == [2] and [r.titulo for r in left.collect()] == ["c"]


def test_catalogue_reload_and_fields(spark):
    old = spark.createDataFrame([(1, 415, "415[27]", "a", "w", 1, "", True, False, 9.0, "d", "t"), (2, 415, "415.2", "b", "w", 1, "", False, True, None, None, None)], schemas.CATALOGUE)
    new = old.select("fila", "orden", "numero", "autor", "obras", "paginas", "notas")
    out = {r.numero: r for r in S.reload_catalogue(old, new).collect()}
    assert (out["415[27]"].poseido, out["415[27]"].precio_objetivo, out["415.2"].deseado, out["415.2"].poseido) == (True, 9.0, True, False)
    changed = S.set_fields(old, spark.createDataFrame([("415", 5.0), ("415.2", 6.0)], "key string, precio_objetivo double"))
    assert {r.numero: r.precio_objetivo for r in changed.collect()} == {"415[27]": 5.0, "415.2": 6.0}
    with pytest.raises(ValueError):
        S.set_fields(old, spark.createDataFrame([("1", 1)], "key string, orden int"))


def test_catalogue_search(spark):
    rows = spark.createDataFrame([(1, 7, "7", "Platón", "Diálogos", 1, "", False, False, None, "sobre el alma", None), (2, 0, "8", "Otro", "El alma", 1, "", False, False, None, None, None)], schemas.CATALOGUE)
    found = S.search_catalogue(rows, "ALMA").collect()
    assert [(r.fila, round(r.puntos, 6), r.campos) for r in found] == [(2, 9.6, ["obras"]), (1, 1.6, ["descripcion"])]
    assert S.search_catalogue(rows, "alma platon").count() == 1 and S.search_catalogue(rows, " ").count() == 0
