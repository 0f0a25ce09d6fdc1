import pytest
from pyspark.sql import functions as F

from quire import schemas
from quire.functions import concordance as C
from quire.functions import pages as P
from quire.operators import corpus as K

FULL = "una línea de prosa que llega hasta el margen de la caja del texto como todas sus"


def test_prose_is_one_paragraph():
    got = P.compose("\n".join([FULL] * 10 + ["hermanas."]))
    assert not got["es_verso"] and [k for k, _ in got["bloques"]] == ["parrafo"]


def test_verse_stays_line_by_line():
    got = P.compose("\n".join(["canta oh diosa", "la cólera de Aquiles", "funesta y larga", "que tantos males", "trajo a los aqueos"]))
    assert got["es_verso"] and len(got["bloques"]) == 5


def test_calls_marks_and_titles():
    body = f"9\nA Alipio, hermano de Cesareo\n{FULL}\n{FULL} islas42; fin.\n403d\nLIBRO SEGUNDO\n{FULL}\n{FULL}"
    got = P.compose(body, "1 Primera nota\nque sigue\n[2] Segunda.\nb c d 94a")
    assert got["marcas"] == ["9", "403d"] and got["llamadas"] == ["42"]
    assert ("titulo", "A Alipio, hermano de Cesareo") in got["bloques"] and ("titulo", "LIBRO SEGUNDO") in got["bloques"]
    assert got["notas"] == [("1", "Primera nota que sigue"), ("2", "Segunda. b c d 94a")]


def test_margin_summaries_split_paragraphs():
    body = "\n".join([FULL, FULL, FULL + " y así acabó.", "Entrevista de los generales", "Entonces " + FULL, FULL, FULL])
    kinds = [k for k, _ in P.compose(body)["bloques"]]
    assert kinds == ["parrafo", "titulo", "parrafo"]


def test_trimming():
    blocks = [("parrafo", "cola de frase. Empieza aquí el texto bueno. Y sigue a medias"), ("verso", "un verso sin punto")]
    assert P.start_at_sentence(blocks)[0][1].startswith("Empieza")
    assert P.end_at_sentence(blocks) == [("parrafo", "cola de frase. Empieza aquí el texto bueno.")]
    assert P.end_at_paragraph([("parrafo", "Uno."), ("parrafo", "dos")]) == [("parrafo", "Uno.")]
    assert P.start_at_passage([("parrafo", "nada"), ("parrafo", "Éste es el pasaje buscado")], "Este es el pasaje buscado, y más")[0][1].startswith("Éste")
    assert P.end_at_sentence([]) == [] and P.start_at_passage(blocks, "") == blocks


@pytest.mark.parametrize(("bad", "good"), [("compaρeros", "compañeros"), ("mαs tambiιn", "más también"), ("HIERΣN", "HIERÓN"), ("λόγος ἀλλήλων", "λόγος ἀλλήλων"), ("n٥mero", "número"), ("᾿Oδυσσεύς", "᾿Oδυσσεύς"), ("phýsis gnōsis", "phýsis gnōsis")])
def test_code_page(bad, good):
    assert P.repair_code_page(bad) == good


@pytest.mark.parametrize(("bad", "labels", "good"), [("el triángulo ABΓ y ΣN", False, "el triángulo ΑΒΓ y ΣΝ"), ("ΙII. contenido", False, "III. contenido"), ("Actόrida", False, "Actórida"), ("INTRODUCCIΣN", False, "INTRODUCCIÓN"), ("la recta EK y TITO", True, "la recta ΕΚ y TITO"), ("la recta EK", False, "la recta EK"), ("XII HEATH", True, "XII HEATH")])
def test_alphabets(bad, labels, good):
    assert P.repair_alphabets(bad, labels) == good


def test_invisible_and_hyphens():
    assert P.clean_invisible("a\xa0b​ qui\xad\nsieran qui\xad\n5 x") == "a b quisieran qui\n5 x"
    assert P.join_hyphens(["inter-", "medio", "Fin-", "Otro"]) == "intermedio\nFin-\nOtro"
    assert P.figure_labels("ΑΒΓ ΑΒ ΔΕ λόγος") == 2


@pytest.mark.parametrize(("title", "kind"), [("ÍNDICE DE NOMBRES PROPIOS", "indice_nombres"), ("Í N D I C E  D E  T O P Ó N I M O S", "indice_nombres"), ("Índice", "indice_general"), ("Bibliografía selecta", "bibliografia"), ("Siglas", "abreviaturas"), ("Notas cartas y fragmentos", "notas_finales"), ("Prólogo", "introduccion"), ("Derechos de autor", "portada"), ("LAS NUBES", "texto"), ("Anotaciones", "texto")])
def test_sections(title, kind):
    assert P.section_kind(title) == kind


def test_sheet():
    got = P.sheet(["229D", "229E", "daño[61] quien la toma, es-", "to es"], ["nota"], ["39", "2"], "texto")
    assert got == {"versos": ["39", "2", "229D", "229E"], "capitulos": [39], "llamadas": ["61"], "cuerpo": "daño quien la toma, esto es", "notas": "nota", "nota": None}
    note = P.sheet(["[65] Deuteronomio 32, 9. <<"], [], [], "notas_finales")
    assert (note["nota"], note["cuerpo"]) == ("65", "Deuteronomio 32, 9.")


def test_presentation():
    assert P.highlight("La Ágora y el ágora", ["agora"]) == [("La ", False), ("Ágora", True), (" y el ", False), ("ágora", True)]
    assert P.snippet("x" * 500 + " Aquiles " + "y" * 500, ["aquiles"], 60).count("…") == 2
    assert P.greek_runs("el λόγος es") == [("el ", False), ("λόγος ", True), ("es", False)]
    assert P.mostly_greek("λόγος ab") and not P.mostly_greek("abc")
    assert P.searchable_name("Jenofonte - Anabasis (trad. Ramón Bach)_1982.pdf") == "Jenofonte Anabasis"


INDEX = ["ÍNDICE DE NOMBRES", "Aquiles, 12, 45-47", "80, 92", "Sábata XVI, 4,2", "Ayante, III 189; VI 186", "Ábaris: guerrero de Fineo, muerto por", "Perseo, V 86", "ACADEMIA: Ant. 80, 2; Dión 1, 1; 14, 3", "Fineo, véase Perseo, 3", "Bolonia, 1474"]


def test_concordance(spark):
    want = {"Aquiles": ["12", "45-47", "80", "92"], "Sábata": ["XVI 4, 2"], "Ayante": ["III 189", "VI 186"], "Ábaris": ["V 86"], "ACADEMIA": ["Ant. 80, 2", "Dión 1, 1", "Dión 14, 3"]}
    assert C.names([{"cuerpo": "\n".join(INDEX), "notas": "", "seccion": "texto"}]) == want
    assert C.names([{"cuerpo": "Bolonia, U. Rugerius, 1474", "notas": "", "seccion": "bibliografia"}]) == {}
    pages = spark.createDataFrame([("v", 1, "texto", "nada", ""), ("v", 2, "texto", "\n".join(INDEX[:4]), ""), ("v", 3, "texto", "\n".join(INDEX[1:]), ""), ("w", 1, "texto", "Autor, 12", "")], "canonico string, pdf int, seccion string, cuerpo string, notas string")
    got = {r.canonico: r.indice_nombres for r in K.volume_names(pages).collect()}
    assert set(got) == {"v"} and got["v"]["Ayante"] == ["III 189", "VI 186"]


@pytest.mark.parametrize(("text", "refs"), [("1474, 1500", []), ("12, 45", ["12", "45"]), ("XXIV 1804", ["XXIV 1804"]), ("I 1, 121, 131.", ["I 1", "I 121", "I 131"])])
def test_references(text, refs):
    assert C.refs(text) == refs


def test_sections_and_works_of_pages(spark):
    toc = spark.createDataFrame([("d", 1, "Comedias", 1), ("d", 1, "Introducción", 3), ("d", 1, "LAS NUBES", 10), ("d", 1, "LAS RANAS", 20), ("d", 1, "Notas", 30), ("d", 1, "Índice de nombres", 36)], schemas.TOC)
    counts = spark.createDataFrame([("d", 40), ("e", 5)], "doc string, pages int")
    parts = K.sections(toc, counts)
    assert {r.doc: r.hojas for r in K.text_sheets(parts, counts).collect()} == {"d": 29, "e": 5}
    pages = spark.createDataFrame([("d", p) for p in (2, 5, 12, 25, 31, 40)] + [("e", 1)], "doc string, pdf int")
    got = {(r.doc, r.pdf): (r.seccion, r.obra) for r in K.work_of(K.section_of(pages, parts), K.works_of_toc(toc)).collect()}
    assert got == {("d", 2): ("texto", ""), ("d", 5): ("introduccion", ""), ("d", 12): ("texto", "LAS NUBES"), ("d", 25): ("texto", "LAS RANAS"), ("d", 31): ("notas_finales", "LAS RANAS"), ("d", 40): ("indice_nombres", "LAS RANAS"), ("e", 1): ("texto", "")}


def test_layout(spark):
    spans, boxes = [], []
    for page in range(1, 13):
        boxes.append(("d", page, 400.0, 600.0, 0.0))
        rows = [(20.0, 30.0, 200.0, 40.0, 9.0, "LAS NUBES"), (20.0, 575.0, 60.0, 585.0, 9.0, str(page + 100)), (330.0, 200.0, 350.0, 210.0, 7.0, str(page * 5))]
        rows += [(40.0, 100.0 + 20 * k, 300.0, 110.0 + 20 * k, 11.0, f"renglón {k} de la página con su texto") for k in range(12)] + [(40.0, 500.0, 300.0, 508.0, 8.0, "1 una nota al pie")]
        spans += [("d", page, k, 0, *r) for k, r in enumerate(rows)]
    toc = spark.createDataFrame([("d", 1, "LAS NUBES", 5)], schemas.TOC)
    got = K.page_records(spark.createDataFrame(spans, schemas.SPANS), spark.createDataFrame(boxes, schemas.PAGE_BOXES), toc).orderBy("pdf").collect()
    assert len(got) == 12
    row = got[5]
    assert (row.impresa, row.obra, row.versos, row.notas) == (106, "LAS NUBES", ["30"], "1 una nota al pie") and row.cuerpo.count("\n") == 11


def test_reports(spark):
    pages = spark.createDataFrame([("v", 1, "corto. Uno.\n\nDos.\n\nTres.", "n" * 10), ("v", 2, "ABΓ " * 60, "x"), ("w", 1, "b", "n" * 200)], "canonico string, pdf int, cuerpo string, notas string")
    assert {r.canonico: r.hojas for r in K.composition_report(pages).collect()} == {"v": 2, "w": 1}
    assert [(r.canonico, r.pdf) for r in K.suspicious_pages(pages).collect()] == [("v", 1)]
    assert {r.canonico: r.cuerpo for r in K.unfold_notes(pages).collect() if r.canonico == "w"} == {"w": "b\n" + "n" * 200}
    assert "ΑΒΓ" in {r.pdf: r.cuerpo for r in K.repair(pages).collect() if r.canonico == "v"}[2]
    assert K.volume_totals(pages).count() == 2
    lines = spark.createDataFrame([("aa\n\nbbbb\nc",), ("aa\nbbbb",), ("",)], "t string").select(K.median_line(F.col("t")).alias("m")).collect()
    assert [r.m for r in lines] == [2.0, 3.0, None]


def test_sections_and_works_against_a_plain_search(spark, monkeypatch):
    """Overlapping sections, gaps, equal starts, stretches shorter than a section, sheets without a volume."""
    import random

    monkeypatch.setattr(K, "SWEEP", 7)
    rng = random.Random(4)
    pages = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(60)])) for _ in range(300)]
    parts = [(d, a := rng.randint(0, 60), a + rng.randint(-2, 30), rng.choice("xy"), f"t{k}") for k, d in enumerate(rng.choice(["a", "b", "d"]) for _ in range(25))]
    works = [(rng.choice(["a", "c"]), rng.randint(0, 50), f"w{k}") for k in range(12)]
    sheets = spark.createDataFrame(pages, "doc string, pdf int")
    got = K.work_of(K.section_of(sheets, spark.createDataFrame(parts, "doc string, desde int, hasta int, tipo string, titulo string")), spark.createDataFrame(works, "doc string, page int, title string"))
    want = []
    for d, p in pages:
        held = sorted(x[1:] for x in parts if p is not None and x[0] == d and x[1] <= p <= x[2])
        begun = sorted(x[1:] for x in works if p is not None and x[0] == d and x[1] <= p)
        want.append((d, p, *(held[0][2:] if held else ("texto", "")), begun[-1][1] if begun else ""))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_pages_of_one_row_group_are_composed_by_all_cores(spark, tmp_path):
    from quire.plans import page_queries as Q

    spark.range(40).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    for rows in (Q.composed(spark, str(tmp_path)), Q.QUERIES["trimmed_passages"](spark, str(tmp_path))):
        assert rows.rdd.getNumPartitions() > 1 and rows.count() == 40


def test_the_last_section_has_no_end_of_its_own(spark, tmp_path):
    from quire.plans import corpus_queries as Q

    keys = [0, 60, 1450, 1500, 1_000_000, 1_000_001, 1_200_000]
    spark.createDataFrame([(k, k, 1) for k in keys], "l_partkey long, l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.l_orderkey: r.seccion for r in Q.QUERIES["section_range_join"](spark, str(tmp_path)).collect()}
    assert got == dict(zip(keys, ["portada", "introduccion", "texto", *["notas_finales"] * 4], strict=True))
