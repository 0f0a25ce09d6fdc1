from pyspark.sql import functions as F

from quire import schemas, sql
from quire.operators import views as V

ROWS = [(1, 48, "48", "Homero", "Odisea", 500, "", True, False, None, "d" * 3, None), (2, 361, "361", "Ovidio", "Fastos", 300, "", False, True, None, " ", None)]


def test_collection(spark):
    cat = spark.createDataFrame(ROWS, schemas.CATALOGUE)
    got = {v: [r.fila for r in V.collection_view(cat, v).collect()] for v in ("all", "owned", "wished", "missing", "rare")}
    assert got == {"all": [1, 2], "owned": [1], "wished": [2], "missing": [2], "rare": [2]}
    assert [r.fila for r in V.without_description(cat).collect()] == [2]
    assert tuple(V.catalogue_counts(cat).collect()[0]) == (2, 1, 1, 1)
    assert [r.fila for r in cat.where(V.matches([F.col("autor"), F.col("obras")], "HOMERO od")).collect()] == [1]
    assert tuple(V.index_summary(spark.createDataFrame([], "pasajes int, palabras int, nombres int")).collect()[0]) == (0, 0, 0, 0)


def test_lots(spark):
    cat = spark.createDataFrame(ROWS, schemas.CATALOGUE)
    listings = spark.createDataFrame([("https://s/lote-uno~x1234567", "Ovidio: Fastos\nHomero - Odisea"), ("https://s/otro-lote~x7654321", "nada")], "url string, texto string")
    got = {r.url: r.titulo for r in V.new_lots(listings, cat).collect()}
    title = got["https://s/lote-uno~x1234567"]
    assert title == "[LOTE ×2] Homero — Odisea + Ovidio — Fastos" and got["https://s/otro-lote~x7654321"] == "Otro lote"
    assert sorted(r.fila for r in V.preselected(title, cat).collect()) == [1, 2]


def test_a_lot_named_at_the_end_of_a_long_listing(spark):
    cat = spark.createDataFrame(ROWS, schemas.CATALOGUE)
    lines = [f"otro libro {k}" for k in range(1_000)]
    listings = spark.createDataFrame([("https://s/lote~x1", "\n".join(["Ovidio: Fastos", *lines, "", "Homero - Odisea"])), ("https://s/lote~x2", "; ".join([*lines, "Ovidio: Fastos"]))], "url string, texto string")
    got = {r.url: r.titulo for r in V.new_lots(listings, cat).collect()}
    assert got == {"https://s/lote~x1": "[LOTE ×2] Homero — Odisea + Ovidio — Fastos", "https://s/lote~x2": "[LOTE ×1] Ovidio — Fastos"}


def test_passages(spark):
    assert V.passage_title("Libro I", "", ["AQUILES", "Peleo", "x"], "c") == "Aquiles y Peleo"
    assert V.passage_title("Sobre la educación.", "", [], "c") == "Sobre la educación" and V.passage_title("III", "Libro II", [], "c") == "c"
    assert V.passage_description("Uno corto. Aquí está Aquiles hoy. Esta es la frase más larga de todas.", ["Aquiles"]) == "Aquí está Aquiles hoy."
    assert V.passage_description("x " * 200, [])[-1] == "…" and V.passage_description("", []) == ""
    rows = spark.createDataFrame([("El canto de Aquiles el pélida", "s", "w", ["Aquiles"], "c", 5)], "t string, s string, w string, n array<string>, c string, p int")
    got = rows.select(V.described("t", "s", "w", "n", "c").alias("d"), V.snippets("aquiles", 12)("t").alias("x"), V.highlights("aquiles")("t").alias("h"), V.spread(F.col("p"), F.col("t"), "pelida").alias("l"), V.spread(F.col("p"), F.col("t"), "canto").alias("e")).collect()[0]
    assert got.d.titulo == "Aquiles" and "Aquiles"[:4] in got.x and [h.coincide for h in got.h] == [False, True, False]
    assert tuple(got.l) == (5, 6) and tuple(got.e) == (4, 5)


def test_analysis(spark):
    pages = [("d", i, "texto largo de la obra " * 5) for i in range(1, 21)] + [("d", i, f"[{i}] una nota") for i in range(21, 60)] + [("e", i, "[1] x") for i in range(1, 5)]
    df = spark.createDataFrame(pages, "doc string, pdf int, texto string")
    assert {r.doc: r.cola for r in V.notes_tail(df).collect()} == {"d": 21}
    feet = spark.createDataFrame([("a", "x\nPágina 3"), ("a", "www.s.com - Página 4"), ("b", "x"), ("b", "")], "doc string, texto string")
    assert {r.doc: r.ebook for r in V.digital_editions(feet).collect()} == {"a": True, "b": False}
    known = spark.createDataFrame([("d", 0, 1, None, 2, 9), ("e", 3, 2, 9, 0, 9)], "doc string, marcas int, tamanos int, veces int, faltan int, hojas int")
    assert {r.doc: len(r.dificultades) for r in V.difficulties(known).collect()} == {"d": 4, "e": 0}


def test_sql(spark):
    names = sql.register(spark)
    assert "quire_passages" in names
    assert spark.sql("SELECT quire_fold('ÁÑ nº') AS f, quire_section('Bibliografía') AS s").collect()[0] == ("an no", "bibliografia")
    assert spark.sql("SELECT count(*) FROM quire_passages('" + "a " * 400 + "')").collect()[0][0] == 3
