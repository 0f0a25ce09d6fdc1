import json
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from quire.operators import search
from quire.operators.index_store import Store, alphabetical, joined_names
from quire.operators.search import deal, plan, rank


def volume(folder, name, place, pages, broken=False):
    rows = [{"tipo": "tomo", "canonico": name, "autor": f"Autor {name}", "numero": str(place), "orden": place, "indice_nombres": {"Aquiles": ["1", "2"], "ibid": ["3"]}}]
    rows += [{"tipo": "pagina", "pdf": k, "seccion": "texto", "titulo": "", "obra": "", "cuerpo": t, "notas": ""} for k, t in enumerate(pages, 1)]
    (folder / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)) + ("\n{broken\n" if broken else "\n"))


def found(store, query):
    index = store.index()
    decided, hits = plan(index, query)
    ids = rank(index, decided, hits)
    return sorted((r.canonico, r.hoja) for r in store.table("pasajes").join(ids, "id").collect())


def test_updates(spark, tmp_path):
    source = tmp_path / "volumes"
    source.mkdir()
    store = Store(spark, str(tmp_path / "index"))
    assert store.volumes().collect() == []
    volume(source, "b", 1, ["canta oh diosa", "la cólera de Aquiles"])
    volume(source, "á", 2, ["otro canta"], broken=True)
    first = store.update(str(source))
    assert (first.tomos, first.total, first.pasajes, first.nombres, first.saltados, first.borrados, first.errores) == (2, 2, 3, 2, 0, 0, 1)
    assert found(store, "canta") == [("b", 1), ("á", 1)] and [r.canonico for r in store.volumes().collect()] == ["b", "á"]
    again = store.update(str(source))
    assert (again.tomos, again.saltados, again.pasajes) == (0, 2, 0) and found(store, "colera") == [("b", 2)]
    volume(source, "b", 1, ["nada que ver", "otra hoja más", "y otra canta"])
    (source / "á.jsonl").unlink()
    third = store.update(str(source))
    assert (third.tomos, third.saltados, third.borrados, third.pasajes) == (1, 0, 1, 3)
    assert found(store, "canta") == [("b", 3)] and found(store, "diosa") == []
    store.compact()
    assert found(store, "canta") == [("b", 3)] and store.table("nombres").count() == 1
    forced = store.update(str(source), force=True)
    assert (forced.tomos, forced.saltados, store.table("pasajes").count()) == (1, 0, 3)
    names = joined_names(store.table("nombres").drop("archivo", "generacion"), store.volumes()).collect()
    assert [(r.nombre, r.refs, r.autor, r.orden) for r in names] == [("Aquiles", "1; 2", "Autor b", 1)]


def test_generations_are_merged(spark, tmp_path):
    """After each run the answers are those of an index built at once, and generations stay few."""
    source = tmp_path / "volumes"
    source.mkdir()
    store = Store(spark, str(tmp_path / "index"), fanout=2)
    for turn in range(6):
        volume(source, f"v{turn}", turn, [f"canta la musa {turn}", "otra hoja" + " más" * turn])
        if turn == 3:
            volume(source, "v0", 0, ["canta de nuevo"])
        if turn == 4:
            (source / "v1.jsonl").unlink()
        store.update(str(source))
        live = {r.generacion for r in store.manifest().collect()}
        assert len(live) <= 3
    whole = Store(spark, str(tmp_path / "whole"))
    whole.update(str(source))
    for query in ("canta", "otra mas", '"la musa"', "mus*"):
        assert found(store, query) == found(whole, query) and found(store, query)
    scores = lambda s: sorted(round(r.bm, 9) for r in rank(s.index(), *plan(s.index(), "canta musa")).collect())
    assert scores(store) == scores(whole) and store.table("pasajes").select("id").distinct().count() == store.index().passages == whole.index().passages
    assert {int(f.name.split("=")[1]) for f in (tmp_path / "index" / "postings").iterdir() if f.name.startswith("generacion=")} >= live
    asked = store.index().find(["canta"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"part#\d+ = \d+", asked)


def test_alphabetical(spark):
    rows = spark.createDataFrame([(n,) for n in ("Zenón", "Ésquilo", "Esopo", "ánfora")], "canonico string")
    assert [r.canonico for r in alphabetical(rows).collect()] == ["ánfora", "Esopo", "Ésquilo", "Zenón"]


def test_a_full_part_is_dealt_to_several_tasks(spark):
    """Postings of two million passages: one part isn't one task's."""
    rows = spark.range(20_000).withColumn("part", F.lit(3))
    sizes = [r["count"] for r in deal(rows, "id", 4, 2_000_000).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 8 and max(sizes) < 8_000 and sum(sizes) == 20_000


def test_a_run_shuffles_neither_passages_nor_postings(spark, tmp_path, monkeypatch):
    """Passages are numbered where they are cut, postings written where they are found; ids stay apart."""
    source, plans, add = tmp_path / "volumes", {}, Store._add
    source.mkdir()
    for k in range(5):
        volume(source, f"v{k}", k, [f"canta la musa {k}", "otra hoja"])

    def looked_at(self, name, rows, *options, **more):
        plans[name] = rows._jdf.queryExecution().executedPlan().toString()
        add(self, name, rows, *options, **more)

    monkeypatch.setattr(Store, "_add", looked_at)
    store = Store(spark, str(tmp_path / "index"))
    store.update(str(source))
    assert "row_number()" not in plans["pasajes"] and "hashpartitioning(id" not in plans["postings"]
    ids = [r.id for r in store.table("pasajes").collect()]
    assert len(set(ids)) == 10 and {i >> 44 for i in ids} == {0}
    assert found(store, "canta") == [(f"v{k}", 1) for k in range(5)]
    assert {(r.archivo.rsplit("/")[-1], r.n) for r in store.table("postings").groupBy("archivo").agg(F.sum("tf").alias("n")).collect()} == {(f"v{k}.jsonl", 6) for k in range(5)}
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_runs_are_sorted_and_whole(monkeypatch):
    rng = random.Random(3)
    texts = [{"id": {"id": k, "v": k % 3}, "tokens": rng.choices("abcdefg", k=rng.randint(0, 9)) if k else None} for k in range(50)]
    kind = pa.schema([("id", pa.struct([("id", pa.int64()), ("v", pa.int32())])), ("tokens", pa.list_(pa.string()))])
    batches = [pa.RecordBatch.from_pylist(texts[k : k + 7], kind) for k in range(0, 50, 7)]
    monkeypatch.setattr(search, "RUN", 20)
    rows = [r for b in search._in_runs(iter(batches)) for r in b.to_pylist()]
    by = lambda rs: sorted((r["term"], r["id"]["id"], r["id"]["v"], r["tf"], r["positions"], r["dl"]) for r in rs)
    assert by(rows) == by([r for b in search._inverted(iter(batches)) for r in b.to_pylist()]) and rows
    runs = {}
    for r in rows:
        runs.setdefault(r["id"]["id"] // 21, []).append(r["term"])
    assert len(runs) == 3 and all(terms == sorted(terms) for terms in runs.values())
    assert list(search._in_runs(iter([]))) == []
