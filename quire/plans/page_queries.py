"""Queries of layout, composition, repair and what is shown of pages, each with its SQL.

Volumes and pages are made from rows by a template, so the SQL states what must be read back; documents are used as they are where SQL
can say the rule itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire import schemas
from quire.functions import mail as M
from quire.functions import pages as P
from quire.functions import text as T
from quire.operators import corpus as K
from quire.operators import search as R
from quire.operators import views as V
from quire.plans.search_queries import _SECTIONS, _WS, CHUNKS, table
from quire.plans.source_queries import _letters, letters, text
from quire.plans.store_queries import read
from quire.session import spread, work_path
from quire.sql import register

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- layout -------------------------------------------------------------------------------------------------------------

SHEETS = 12


def layout(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spans, boxes, table of contents): a volume of twelve sheets a nation; each sheet has a running head, a folio, a margin reference, twelve lines and a note."""
    n, p = F.col("n_nationkey"), F.col("page")
    sheets = read(spark, sf, "nation").select("n_nationkey", "n_name", F.explode(F.sequence(F.lit(1), F.lit(SHEETS))).alias("page"))
    span = lambda x0, y0, x1, y1, size, t: F.struct(F.lit(float(x0)).alias("x0"), F.lit(float(y0)).alias("y0"), F.lit(float(x1)).alias("x1"), F.lit(float(y1)).alias("y1"), F.lit(float(size)).alias("size"), t.alias("text"))
    own = [span(20, 30, 200, 40, 9, text("OBRA ", F.col("n_name"))), span(20, 575, 60, 585, 9, (p + 100 + n).cast("string")), span(330, 200, 350, 210, 7, (p * 5).cast("string"))]
    own += [span(40, 100 + 20 * k, 300, 110 + 20 * k, 11, F.lit(f"renglón {k} de la página con su texto")) for k in range(12)]
    own.append(span(40, 500, 300, 508, 8, F.lit("1 una nota al pie")))
    doc = text("v", n).alias("doc")
    spans = sheets.select(doc, "page", F.posexplode(F.array(*own)).alias("block", "s")).select("doc", "page", "block", F.lit(0).alias("line"), "s.*")
    boxes = sheets.select(doc, "page", F.lit(400.0).alias("width"), F.lit(600.0).alias("height"))
    toc = read(spark, sf, "nation").select(doc, F.lit(1).alias("level"), text("OBRA ", F.col("n_name")).alias("title"), F.lit(5).alias("page"))
    return spans, boxes, toc


_BODY = "array_to_string(list_transform(range(0, 12), lambda k: 'renglón ' || CAST(k AS VARCHAR) || ' de la página con su texto'), chr(10))"


@query(f"""SELECT 'v' || CAST(n_nationkey AS VARCHAR) AS canonico, p::INT AS pdf, (p + 100 + n_nationkey)::INT AS impresa, 'texto' AS seccion, CASE WHEN p >= 5 THEN 'OBRA ' || n_name ELSE '' END AS titulo,
 'OBRA ' || n_name AS obra, CAST(p * 5 AS VARCHAR) AS versos, {_BODY} AS cuerpo, '1 una nota al pie' AS notas FROM nation, range(1, {SHEETS + 1}) t(p)""")
def layout_records(spark, sf):
    """Page records from spans: heads, folios, margin references, notes and body told apart by place and type."""
    return K.page_records(*layout(spark, sf)).select("canonico", "pdf", "impresa", "seccion", "titulo", "obra", F.array_join("versos", ",").alias("versos"), "cuerpo", "notas")


@query(f"""WITH v AS (SELECT 'v' || CAST(n_nationkey AS VARCHAR) AS doc, n_nationkey AS n, n_name FROM nation)
SELECT doc, 'umbral ' || CAST(p AS VARCHAR) AS que, '9.35' AS valor FROM v, range(1, {SHEETS + 1}) t(p) UNION ALL SELECT doc, 'cabecera', lower('OBRA ' || n_name) FROM v UNION ALL SELECT doc, 'desfase', CAST(-100 - n AS VARCHAR) || ' {SHEETS}' FROM v
UNION ALL SELECT doc, 'cuerpo', '11.0 4' FROM v UNION ALL SELECT doc, 'formato', CASE WHEN n % 2 = 0 THEN 'ebook' ELSE 'impreso' END FROM v UNION ALL SELECT doc, 'limite', '{SHEETS}' FROM v""")
def layout_measures(spark, sf):
    """What is measured of a volume: the size of notes a sheet, running heads, the offset of its folios, the body's type, its format, where its text ends."""
    spans, boxes, _ = layout(spark, sf)
    lines = K.lines_of(spans)
    foot = F.when(F.substring("doc", 2, 9).cast("int") % 2 == 0, text("algo de texto\nPágina ", F.col("page"))).otherwise("algo de texto")
    pages = boxes.select("doc", F.col("page").alias("pdf"), foot.alias("texto"))
    tails = spark.createDataFrame([], "doc string, cola int")
    limits = K.text_limit(boxes.groupBy("doc").agg(F.max("page").alias("pages")), tails)
    said = lambda t, what, *value: t.select("doc", what.alias("que") if not isinstance(what, str) else F.lit(what).alias("que"), F.concat_ws(" ", *[v.cast("string") for v in value]).alias("valor"))
    return union(
        [
            said(K.note_threshold(spans), text("umbral ", F.col("page")), F.round("umbral", 2)),
            said(K.running_heads(lines, boxes), "cabecera", F.col("head")),
            said(K.folio_offset(lines, boxes), "desfase", F.col("desfase"), F.col("veces")),
            said(K.body_size(spans, limits), "cuerpo", F.col("cuerpo_pt"), F.col("tamanos")),
            said(K.layout_format(pages, lines, boxes, tails), "formato", F.col("formato")),
            said(limits, "limite", F.col("limite")),
        ]
    )


@query("""SELECT 'v' || CAST(n_nationkey AS VARCHAR) AS doc, CAST(CASE WHEN n_nationkey % 4 = 3 THEN 35 ELSE 31 END AS INT) AS cola FROM nation WHERE n_nationkey % 4 <> 0""")
def notes_tails(spark, sf):
    """Where the run of notes, one a sheet, begins that a volume ends with; little text doesn't end it, four sheets of text do."""
    n, p = F.col("n_nationkey"), F.col("pdf")
    own = "w" * 60
    note = text("[", p, "] nota")
    sheet = (
        F.when(n % 4 == 0, own)
        .when(n % 4 == 2, F.when(p > 30, F.when(p % 7 == 0, "corto").otherwise(note)).otherwise(own))
        .when(n % 4 == 3, F.when(p > 34, note).when((p > 30) | (p < 20), own).otherwise(note))
        .otherwise(F.when(p > 30, note).otherwise(own))
    )
    rows = read(spark, sf, "nation").select(text("v", n).alias("doc"), "n_nationkey", F.explode(F.sequence(F.lit(1), F.lit(60))).alias("pdf"))
    return V.notes_tail(rows.select("doc", "pdf", sheet.alias("texto"))).select("doc", F.col("cola").cast("int").alias("cola"))


_TOC = [("Portada", 1), ("Introducción", 4), ("{n}", 10), ("{n}", 20), ("Notas", 30), ("Í N D I C E  D E  N O M B R E S", 36)]


@query("""SELECT 'v' || CAST(n_nationkey AS VARCHAR) AS doc, desde::INT AS desde, hasta::INT AS hasta, tipo, CASE tipo WHEN 'texto' THEN n_name ELSE titulo END AS titulo
FROM nation, (VALUES (1, 3, 'portada', 'Portada'), (4, 9, 'introduccion', 'Introducción'), (10, 29, 'texto', ''), (30, 35, 'notas_finales', 'Notas'), (36, 40, 'indice_nombres', 'Í N D I C E  D E  N O M B R E S')) t(desde, hasta, tipo, titulo)
UNION ALL SELECT 'v' || CAST(n_nationkey AS VARCHAR), 0, 29, 'hojas', '' FROM nation UNION ALL SELECT 'v' || CAST(n_nationkey AS VARCHAR), p, p, 'obra', n_name FROM nation, (VALUES (10), (20)) u(p)""")
def sections_of_toc(spark, sf):
    """Sections from a table of contents, the sheets before notes and indices, and the works it lists."""
    nation = read(spark, sf, "nation")
    doc = text("v", F.col("n_nationkey")).alias("doc")
    entries = F.array(*[F.struct(F.lit(1).alias("level"), (F.col("n_name") if t == "{n}" else F.lit(t)).alias("title"), F.lit(p).alias("page")) for t, p in _TOC])
    toc, counts = nation.select(doc, F.inline(entries)), nation.select(doc, F.lit(40).alias("pages"))
    parts = K.sections(toc, counts)
    sheets = K.text_sheets(parts, counts).select("doc", F.lit(0).alias("desde"), F.col("hojas").cast("int").alias("hasta"), F.lit("hojas").alias("tipo"), F.lit("").alias("titulo"))
    works = K.works_of_toc(toc).select("doc", F.col("page").alias("desde"), F.col("page").alias("hasta"), F.lit("obra").alias("tipo"), F.col("title").alias("titulo"))
    return union([parts.withColumn("hasta", F.col("hasta").cast("int")), sheets, works])


# --- composition --------------------------------------------------------------------------------------------------------

FULL = "una línea de prosa que llega hasta el margen de la caja del texto como todas sus"
_VERSES = ["canta oh diosa", "la cólera de aquiles", "funesta y larga", "que tantos males", "trajo a los aqueos"]
_NOTES = "1 Nota primera\nque sigue\n[2] Otra.\nb c d 94a"


def _orders(spark, sf) -> DataFrame:
    """Keys of orders, over all cores: a file of a million orders is one row group, and its pages would be composed by one task."""
    return spread(read(spark, sf, "orders").select("o_orderkey", "o_custkey"))


def composed(spark, sf) -> DataFrame:
    """Orders as pages: a mark, a title, some full lines and a last one with the number of a note; every third is verse."""
    n = F.col("o_orderkey")
    prose = text(F.col("o_custkey") % 900 + 1, "\nCarta a ", letters(n), "\n", F.repeat(F.lit(FULL + "\n"), (n % 4 + 4).cast("int")), "islas42 y fin.\n")
    body = F.when(n % 3 == 0, F.lit("\n".join(_VERSES))).otherwise(prose)
    return _orders(spark, sf).select(n, text("v", F.col("o_custkey") % 20).alias("canonico"), n.alias("pdf"), body.alias("cuerpo"), F.lit(_NOTES).alias("notas"))


_PAGE_SQL = f"""SELECT o_orderkey, 'v' || CAST(o_custkey % 20 AS VARCHAR) AS canonico, o_orderkey % 3 = 0 AS verso, CAST(o_custkey % 900 + 1 AS VARCHAR) AS marca, 'Carta a ' || {_letters('o_orderkey')} AS titulo,
 repeat('{FULL} ', CAST(o_orderkey % 4 + 4 AS INT)) || 'islas y fin.' AS parrafo, o_orderkey % 4 + 4 AS llenas FROM orders"""


@query(f"""SELECT o_orderkey, verso AS es_verso, CASE WHEN verso THEN '{"|".join("verso:" + v for v in _VERSES)}' ELSE 'titulo:' || titulo || '|parrafo:' || parrafo END AS bloques, CASE WHEN verso THEN '' ELSE marca END AS marcas,
 CASE WHEN verso THEN '' ELSE '42' END AS llamadas, '1:Nota primera que sigue|2:Otra. b c d 94a' AS notas FROM ({_PAGE_SQL})""")
def composed_pages(spark, sf):
    """Blocks, marks, calls and notes of pages."""
    rows = composed(spark, sf).select("o_orderkey", P.composed("cuerpo", "notas").alias("p"))
    joined = lambda c, a, b: F.array_join(F.transform(c, lambda x: F.concat(x[a], F.lit(":"), x[b])), "|")
    return rows.select("o_orderkey", "p.es_verso", joined("p.bloques", "tipo", "texto").alias("bloques"), F.array_join("p.marcas", "|").alias("marcas"), F.array_join("p.llamadas", "|").alias("llamadas"), joined("p.notas", "numero", "texto").alias("notas"))


@query(f"""SELECT canonico, count(*) AS hojas, sum(CASE WHEN verso THEN 5 ELSE llenas + 3 END)::BIGINT AS renglones, sum(CASE WHEN verso THEN 5 ELSE 2 END)::BIGINT AS bloques, count(*) FILTER (WHERE NOT verso) AS parrafos, 5 * count(*) FILTER (WHERE verso) AS versos,
 count(*) FILTER (WHERE NOT verso) AS marcas, count(*) FILTER (WHERE NOT verso) AS llamadas, round(sum(CASE WHEN verso THEN 5 ELSE llenas + 3 END) / sum(CASE WHEN verso THEN 5 ELSE 2 END), 1) AS por_bloque FROM ({_PAGE_SQL}) GROUP BY canonico""")
def composed_report(spark, sf):
    return K.composition_report(composed(spark, sf).drop("o_orderkey"))


@query("""SELECT canonico, pdf::INT AS pdf, cortos::INT AS cortos, parrafos::INT AS parrafos FROM (SELECT 'v' || CAST(o_custkey % 20 AS VARCHAR) AS canonico, o_orderkey AS pdf, o_orderkey % 4 + 1 AS cortos, o_orderkey % 4 + 1 + (o_orderkey % 2) AS parrafos FROM orders)
WHERE cortos >= 3 ORDER BY cortos / parrafos DESC, cortos DESC, canonico, pdf LIMIT 20""")
def short_paragraphs(spark, sf):
    """The sheets whose paragraphs are mostly short, the worst first."""
    n = F.col("o_orderkey")
    long = "Frase larga " + "de muchas palabras " * 8 + "y fin."
    body = F.concat(F.repeat(F.lit("Párrafo corto de un renglón.\n\n"), (n % 4 + 1).cast("int")), F.when(n % 2 == 1, F.lit(long)).otherwise(""))
    rows = _orders(spark, sf).select(text("v", F.col("o_custkey") % 20).alias("canonico"), n.cast("int").alias("pdf"), body.alias("cuerpo"))
    return K.suspicious_pages(rows).select("canonico", "pdf", "cortos", "parrafos")


@query(f"""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'parrafo:Empieza aquí ' || {_letters('o_orderkey')} || '.' WHEN 1 THEN 'parrafo:Éste es el pasaje buscado ' || {_letters('o_orderkey')} || '.' ELSE 'parrafo:' || {_letters('o_orderkey')} || ' sin fin ni principio' END AS bloques FROM orders""")
def trimmed_passages(spark, sf):
    """Pages from where a passage begins, without the tails of sentences at both ends, unless too much would be lost."""
    n = F.col("o_orderkey")
    own = letters(n)
    body = F.when(n % 3 == 0, text("cola de frase. Empieza aquí ", own, ". Y sigue a medias")).when(n % 3 == 1, text("Nada que ver.\n\nÉste es el pasaje buscado ", own, ". sigue")).otherwise(text(own, " sin fin ni principio"))
    wanted = F.when(n % 3 == 1, text("Este es el pasaje buscado ", own)).otherwise("")
    rows = _orders(spark, sf).select("o_orderkey", P.trimmed(body, wanted).alias("b"))
    return rows.select("o_orderkey", F.array_join(F.transform("b", lambda x: F.concat(x["tipo"], F.lit(":"), x["texto"])), "|").alias("bloques"))


# --- repair -------------------------------------------------------------------------------------------------------------

_MENDS = [("el triángulo ABΓ y ΣN", "el triángulo ΑΒΓ y ΣΝ"), ("ΙII. contenido", "III. contenido"), ("Actόrida", "Actórida"), ("INTRODUCCIΣN", "INTRODUCCIÓN"), ("dos veces qui­\nsieran", "dos veces quisieran"), ("ἄνδρα μοι ἔννεπε, Mοῦσα", "ἄνδρα μοι ἔννεπε, Μοῦσα")]


@query("SELECT p_partkey, p_name || chr(10) || CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN '{good}'" for i, (_, good) in enumerate(_MENDS)) + " END AS cuerpo, CASE WHEN p_partkey % 2 = 0 THEN 'la recta ΕΚ' ELSE 'la recta EK' END AS notas FROM part")
def mended_letters(spark, sf):
    """Letters back in their alphabets; labels of figures only in volumes that have many Greek ones."""
    n = F.col("p_partkey")
    bad = F.element_at(F.array(*[F.lit(b) for b, _ in _MENDS]), (n % 6 + 1).cast("int"))
    pages = read(spark, sf, "part").select(text("v", n % 2).alias("canonico"), n.alias("pdf"), text(F.col("p_name"), "\n", bad).alias("cuerpo"), F.lit("la recta EK").alias("notas"))
    figures = pages.limit(1).select(F.lit("v0").alias("canonico"), F.lit(-1).cast("long").alias("pdf"), F.lit("ΓΔ ΘΛ ΞΠ ΣΦ ΨΩ " * 20).alias("cuerpo"), F.lit("").alias("notas"))
    return K.repair(pages.unionByName(figures)).where("pdf >= 0").select(F.col("pdf").alias("p_partkey"), "cuerpo", "notas")


@query("""WITH h AS (SELECT n_nationkey AS n, n_nationkey % 4 = 0 AS rota FROM nation)
SELECT 'v' || CAST(n AS VARCHAR) AS canonico, concat_ws('; ', '1 secciones reclasificadas', CASE WHEN n % 2 = 1 THEN 'hojas de texto' END, CASE WHEN n % 3 = 0 THEN 'formato' END, CASE WHEN rota THEN '1 bloques con letras recuperadas' END, CASE WHEN n % 7 = 0 THEN '10 hojas con las notas desbordadas' END,
 CASE WHEN rota OR n % 7 = 0 THEN 'recuento de palabras' END) AS reparado,
 concat_ws('; ', CASE WHEN n % 5 = 0 THEN 'parece guardado en el tomo equivocado' END, 'sin índice de nombres', 'poco texto por hoja (' || printf('%.0f', (CASE WHEN n % 7 = 0 THEN 70 ELSE 10 END + CASE WHEN rota THEN 1 ELSE 0 END) / 6) || ' palabras): conviene volver a analizar el PDF') AS avisos FROM h""")
def corpus_reports(spark, sf):
    """A stored corpus looked over: what was mended, and what can't be."""
    n = F.col("n_nationkey")
    nation = read(spark, sf, "nation")
    canonical = text("v", n).alias("canonico")
    parts = F.array(F.struct(F.lit(1).alias("desde"), F.lit(6).alias("hasta"), F.lit("texto").alias("tipo"), F.lit("LAS NUBES").alias("titulo")), F.struct(F.lit(7).alias("desde"), F.lit(10).alias("hasta"), F.lit("texto").alias("tipo"), F.lit("Notas").alias("titulo")))
    headers = nation.select(canonical, F.lit(10).alias("paginas_pdf"), F.when(n % 2 == 0, 6).otherwise(10).alias("hojas_texto"), F.when(n % 3 == 0, "").otherwise("impreso").alias("formato"), F.lit(10).cast("long").alias("palabras"), F.lit(0).alias("nombres"), parts.alias("secciones"), F.lit("Homero").alias("autor"))
    body = F.when((n % 4 == 0) & (F.col("pdf") == 1), "INTRODUCCIΣN palabra").otherwise("palabra")
    pages = nation.select("n_nationkey", canonical, F.explode(F.sequence(F.lit(1), F.lit(10))).alias("pdf")).select("canonico", "pdf", F.lit("texto").alias("seccion"), F.lit("").alias("titulo"), F.lit("").alias("obra"), body.alias("cuerpo"), F.when(n % 7 == 0, "primero segundo tercero cuarto quinto sextoo").otherwise("").alias("notas"))
    expected = nation.select(canonical, F.when(n % 5 == 0, "Ovidio").otherwise("Homero").alias("autor_pdf"))
    report = K.corpus_report(headers, pages, expected)[1]
    return report.select("canonico", F.array_join("reparado", "; ").alias("reparado"), F.array_join("avisos", "; ").alias("avisos"))


_FAULTS = """WITH v AS (SELECT p_partkey AS n, ['native', 'ocr_bueno', 'ocr_sucio', 'sin_texto'][p_partkey % 4 + 1] AS estado, p_partkey % 3 = 0 AS ebook, p_size * 1000 AS palabras FROM part)
SELECT n AS doc, CASE WHEN estado = 'sin_texto' THEN 'es un escaneo: no contiene texto, solo imágenes' ELSE concat_ws('; ', CASE WHEN n % 2 = 0 THEN 'no se distinguen las notas al pie: van con el mismo tamaño de letra que el texto' END,
 CASE WHEN ebook THEN 'es una edición digital (EPUB pasado a PDF): no lleva la página del papel, así que se cita por obra, sección y número de verso' END,
 CASE estado WHEN 'ocr_sucio' THEN 'el texto viene de un reconocimiento óptico con muchos errores: las búsquedas literales fallarán a menudo' WHEN 'ocr_bueno' THEN 'el texto viene de un reconocimiento óptico: puede tener erratas sueltas' END,
 CASE WHEN n % 5 = 0 THEN 'no se ha encontrado índice de nombres: se podrá buscar en el texto, pero sin la concordancia del traductor' || CASE WHEN ebook THEN ' (las ediciones digitales suelen suprimirlo; no es cosa de esta copia)' ELSE '' END END,
 CASE n % 4 WHEN 1 THEN '2 hojas son solo imagen (cubierta o láminas): no hay texto que perder' WHEN 2 THEN '3 páginas del PDF no llevan texto (3 %): se pueden reconocer aparte' WHEN 0 THEN CASE WHEN n % 8 = 0 THEN '50 páginas del PDF no llevan texto (50 %): faltan demasiadas, mejor buscar otra copia' END END,
 CASE WHEN palabras < 20000 THEN 'muy poco texto para un tomo (' || replace(format('{:,}', palabras), ',', '.') || ' palabras): puede estar incompleto' END,
 CASE WHEN n % 7 <> 3 THEN 'por el nombre, este PDF parece el tomo ' || CAST(n % 7 AS VARCHAR) || ', no el que has elegido' END) END AS dificultades FROM v"""


def _analysed(spark, sf) -> DataFrame:
    n = F.col("p_partkey")
    missing = F.when(n % 4 == 1, F.array(F.lit(1), F.lit(2))).when(n % 4 == 2, F.array(F.lit(5), F.lit(6), F.lit(50))).when(n % 8 == 0, F.sequence(F.lit(10), F.lit(59))).otherwise(F.array().cast("array<int>"))
    state = F.element_at(F.array(*map(F.lit, ("native", "ocr_bueno", "ocr_sucio", "sin_texto"))), (n % 4 + 1).cast("int"))
    works = F.when(n % 2 == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), (n % 7 + 1).cast("int")), lambda k: text("Obra número ", k, " con un título muy largo")))
    return read(spark, sf, "part").select(
        n.alias("doc"), state.alias("estado"), F.when(n % 3 == 0, "ebook").otherwise("impreso").alias("formato"), (n % 2 + 1).cast("int").alias("tamanos"), (n % 5).cast("int").alias("nombres"), missing.alias("faltan"), F.lit(100).alias("paginas_pdf"),
        (F.col("p_size") * 1000).alias("palabras"), (n % 7).cast("int").alias("orden_detectado"), F.lit(3).alias("orden_elegido"), F.lit(80).alias("hojas_texto"), F.lit(24.4).alias("legibilidad"), (n % 2 * 300).cast("int").alias("paginas_impresas"), F.lit(4).alias("n_secciones"),
        works.alias("obras"), (n % 3).cast("int").alias("reconocidas"), F.when(n % 4 == 0, None).otherwise(n % 3 - 1).cast("int").alias("desfase"),
    )


@query(_FAULTS)
def volume_difficulties(spark, sf):
    """What an analysis warns of, in order."""
    return K.volume_difficulties(_analysed(spark, sf)).select("doc", F.array_join("dificultades", "; ").alias("dificultades"))


@query("""WITH v AS (SELECT p_partkey AS n, ['native', 'ocr_bueno', 'ocr_sucio', 'sin_texto'][p_partkey % 4 + 1] AS estado, p_partkey % 3 = 0 AS ebook, p_size * 1000 AS palabras FROM part)
SELECT n AS doc, CASE WHEN estado = 'sin_texto' THEN 'Este PDF es un ESCANEO: no lleva texto dentro, solo imágenes de las páginas.' || chr(10) || chr(10) || 'No se puede indexar tal cual: busca otra copia en la que se pueda seleccionar el texto.' ELSE concat_ws(chr(10),
 CASE WHEN ebook THEN 'Hojas del PDF: 100 (80 de texto y 20 de notas finales)' ELSE 'Páginas: 100' END,
 CASE WHEN n % 2 = 1 THEN 'Obras del volumen: ' || CAST(n % 7 + 1 AS VARCHAR) || ' — ' || array_to_string(list_transform(range(1, least(4, n % 7 + 1) + 1), lambda k: ('Obra número ' || CAST(k AS VARCHAR) || ' con un título muy largo')[1:28]), ', ') || CASE WHEN n % 7 + 1 > 4 THEN '…' ELSE '' END END,
 CASE WHEN ebook AND n % 2 = 1 THEN 'El tomo en papel tiene 300 páginas; esta edición digital no las conserva' END, 'Palabras extraídas: ' || replace(format('{:,}', palabras), ',', '.'),
 'Calidad del texto: ' || replace(estado, '_', ' ') || ' (24 % de palabras reconocidas)', 'Secciones detectadas: 4', 'Nombres del índice: ' || CAST(n % 5 AS VARCHAR),
 CASE n % 4 WHEN 1 THEN 'Hojas que son solo imagen: 2 (cubierta o láminas)' WHEN 2 THEN 'Páginas sin reconocer: 3 (3 %)' WHEN 0 THEN CASE WHEN n % 8 = 0 THEN 'Páginas sin reconocer: 50 (50 %)' END END,
 CASE WHEN n % 3 > 0 THEN 'Reconocidas con OCR: ' || CAST(n % 3 AS VARCHAR) END,
 CASE WHEN n % 4 = 0 THEN NULL WHEN n % 3 = 1 THEN 'La página impresa coincide con la del PDF' WHEN n % 3 = 2 THEN 'Página impresa = página del PDF menos 1' ELSE 'Página impresa = página del PDF más 1' END) END AS resumen FROM v""")
def volume_summaries(spark, sf):
    return K.summary(_analysed(spark, sf))


# --- quality of texts ---------------------------------------------------------------------------------------------------

_COMMON = "['de','la','el','los','las','que','en','un','una','por','con','para','su','del','al','se','es','no','como','más','mas','pero','sus','le','ha','o','este','sí','si','porque','entre','cuando','muy','sin']"
_UNI = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"


def _quality(t: str) -> dict[str, str]:
    words = f"len(regexp_extract_all({t}, '[^{_WS}]+'))"
    legible = f"len(list_filter(regexp_extract_all({t}, '[{_UNI}]+'), lambda w: list_contains({_COMMON}, lower(w)))) / greatest({words}, 1) * 100"
    odd = rf"""length(regexp_replace({t}, '[{_UNI}\s\x0B\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200D}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}.,;:!¡?¿()\[\]«»"''—–/%&*†°º-]', '', 'g')) / greatest(length({t}), 1) * 100"""
    lines = rf"list_filter(regexp_split_to_array({t}, '\r\n|[\n\x0B\f\r\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_matches(x, '[^{_WS}]'))"
    junk = f"len(list_filter({lines}, lambda x: regexp_matches(x, '(?i)[a-z]*(zyxwvu|vutsrq|ponmlk|jihgfe)[a-zA-Z]*'))) / greatest(len({lines}), 1) * 100"
    short = f"length(regexp_replace({t}, '^[{_WS}]+|[{_WS}]+$', '', 'g')) < 500"
    state = f"CASE WHEN {short} THEN 'none' WHEN {legible} > 22 AND {odd} < 0.5 AND {junk} < 1 THEN 'native' WHEN {legible} > 15 AND {odd} < 2 THEN 'good' ELSE 'dirty' END"
    return {"state": state, "legible": f"CASE WHEN {short} THEN 0.0 ELSE {legible} END"}


_Q = _quality("t")


#: The SQL of queries over documents that stand with the others of their kind.
SQL["text_quality"] = f"SELECT doc_id, {_Q['state']} AS state, round(CAST({_Q['legible']} AS DOUBLE), 6) AS legible FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"
SQL["volume_totals"] = f"""WITH d AS (SELECT source AS canonico, doc_id AS pdf, coalesce(text, '') AS cuerpo FROM documents WHERE doc_id IS NOT NULL),
m AS (SELECT canonico, string_agg(cuerpo, chr(10) ORDER BY length(cuerpo) DESC, pdf) AS t FROM (SELECT *, row_number() OVER (PARTITION BY canonico ORDER BY length(cuerpo) DESC, pdf) AS r FROM d) WHERE r <= 25 GROUP BY canonico),
s AS (SELECT canonico, count(*) AS hojas, sum(len(regexp_extract_all(cuerpo, '[^ \\t\\n\\x0B\\f\\r]+')))::BIGINT AS palabras, sum(length(cuerpo))::BIGINT AS cuerpo FROM d GROUP BY canonico)
SELECT canonico, hojas, palabras, cuerpo, 0::BIGINT AS notas, {_Q['state']} AS estado FROM s JOIN m USING (canonico)"""
SQL["corpus_repair"] = r"""SELECT source AS canonico, CAST(doc_id AS INT) AS pdf, CAST(length(regexp_replace(regexp_replace(text, '\x{AD}[ \t]*\n[ \t]*([A-Za-zÁÉÍÓÚÜÑáéíóúüñ])', '\1', 'g'), '[\x{2060}\x{200B}\x{FEFF}\x{AD}]', '', 'g')) AS INT) AS chars FROM documents WHERE doc_id IS NOT NULL"""
SQL["note_thresholds"] = """WITH s AS (SELECT CAST(l_suppkey % 20 AS VARCHAR) AS doc, CAST(l_orderkey % 300 AS INT) AS page, CAST(8 + l_linenumber % 3 AS DOUBLE) AS size, count(*) * 9 AS n, min(l_linenumber) AS f FROM lineitem GROUP BY 1, 2, 3),
t AS (SELECT doc, page, first(size ORDER BY n DESC, f) * 0.85 AS u, sum(n) AS n FROM s GROUP BY doc, page)
SELECT doc, page, CASE WHEN sum(CASE WHEN size < u THEN s.n ELSE 0 END) BETWEEN 1 AND 0.35 * max(t.n) THEN u ELSE 0.0 END::DOUBLE AS umbral FROM s JOIN t USING (doc, page) GROUP BY doc, page, u"""


# --- whole pages and what is shown --------------------------------------------------------------------------------------

_FLAT = f"trim(regexp_replace(coalesce(text, ''), '[{_WS}]+', ' ', 'g'))"
_SECTION = "[" + ", ".join(f"'{s}'" for s in _SECTIONS) + "][CAST(doc_id % 8 AS INT) + 1]"


SQL["page_recompose"] = f"""SELECT hoja, canonico, CASE WHEN s = 'notas_finales' THEN '' ELSE t END AS cuerpo, CASE WHEN s = 'notas_finales' THEN t ELSE '' END AS notas
FROM (SELECT doc_id AS hoja, source AS canonico, {_SECTION} AS s, {_FLAT} AS t FROM documents WHERE doc_id IS NOT NULL) WHERE t <> ''"""


_NOTED = """SELECT p_partkey AS hoja, p_partkey % 4 = 3 AS lista, CASE p_partkey % 4 WHEN 0 THEN 'obra' WHEN 1 THEN 'editor' WHEN 2 THEN 'notas' ELSE 'aparato' END AS clase,
 CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '1 nota de ' || p_type END AS notas, 2 * (p_size % 3) * 60 + 1 AS palabras FROM part"""


@query(f"""WITH p AS ({_NOTED}) SELECT hoja, clase, count(*) AS pasajes, sum(n)::BIGINT AS palabras FROM (
 SELECT hoja, clase, least(180, w - i * 140) AS n FROM (SELECT *, palabras + CASE WHEN lista AND notas <> '' THEN 4 ELSE 0 END AS w FROM p), range(0, 4) t(i) WHERE i = 0 OR w - 180 > (i - 1) * 140
 UNION ALL SELECT hoja, 'notas', 4 FROM p WHERE NOT lista AND notas <> '') GROUP BY hoja, clase""")
def note_passages(spark, sf):
    """Passages of bodies and of notes by class; the lists at a volume's end keep their notes."""
    n, words = F.col("p_partkey"), (F.col("p_size") % 3 * 60).cast("int")
    section = F.element_at(F.array(*map(F.lit, ("texto", "introduccion", "notas_finales", "indice_nombres"))), (n % 4 + 1).cast("int"))
    pages = read(spark, sf, "part").select(n.alias("hoja"), section.alias("seccion"), F.concat(F.repeat(F.concat("p_name", F.lit(" ")), words), F.lit("fin")).alias("cuerpo"), F.when(n % 5 == 0, "").otherwise(text("1 nota de ", F.col("p_type"))).alias("notas"))
    return R.passages(pages, ["hoja"]).groupBy("hoja", "clase").agg(F.count("*").alias("pasajes"), F.sum("palabras").cast("long").alias("palabras"))


@query(f"SELECT doc_id AS hoja, {_FLAT} AS cuerpo FROM documents WHERE source = 'src1' AND doc_id = (SELECT min(doc_id) FROM documents WHERE source = 'src1' AND doc_id % 8 = 1)")
def whole_page(spark, sf):
    """One sheet, asked for by volume and number."""
    rows = table(spark, sf)
    sheet = rows.where("canonico = 'src1' and hoja % 8 = 1").agg(F.min("hoja")).collect()[0][0]
    return R.whole_page(rows, "src1", -1 if sheet is None else sheet).select("hoja", F.trim(F.regexp_replace("cuerpo", f"{T.SPACE}+", " ")).alias("cuerpo"))


@query("""SELECT p_partkey, 3 * len(regexp_extract_all(lower(t), 'rin|red')) AS marcadas, length(t) AS todas, t AS texto FROM (SELECT p_partkey, p_name || ' · REDINGOTE rín ' || p_type AS t FROM part)""".replace("lower(t)", "strip_accents(lower(t))"))
def highlights(spark, sf):
    """A text as runs that match what was asked for or not."""
    shown = text(F.col("p_name"), " · REDINGOTE rín ", F.col("p_type"))
    rows = read(spark, sf, "part").select("p_partkey", V.highlights("Rin red")(shown).alias("r"))
    return rows.select("p_partkey", F.aggregate(F.filter("r", lambda x: x["coincide"]), F.lit(0), lambda a, x: a + F.length(x["texto"])).alias("marcadas"), F.aggregate("r", F.lit(0), lambda a, x: a + F.length(x["texto"])).alias("todas"), F.array_join(F.transform("r", lambda x: x["texto"]), "").alias("texto"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN repeat('x', 320) || '…' ELSE '…' || repeat('x', 104 - p_size) || ' ' || repeat('a', p_size) || ' Aquíles ' || repeat('y', 320 - 104 - 2 - 8) || '…' END AS trozo FROM part""")
def snippets(spark, sf):
    """The window of a text around what was asked for: 320 characters, a third of them before it."""
    n = F.col("p_size")
    body = F.when(n % 3 == 0, F.lit("x" * 900)).otherwise(F.concat(F.lit("x" * 500), F.lit(" "), F.repeat(F.lit("a"), n), F.lit(" Aquíles "), F.lit("y" * 500)))
    return read(spark, sf, "part").select("p_partkey", V.snippets("aquiles")(body).alias("trozo"))


@query("""SELECT p_partkey, CASE WHEN p_size < 25 THEN p_partkey - 1 ELSE p_partkey END AS izquierda, CASE WHEN p_size < 25 THEN p_partkey ELSE p_partkey + 1 END AS derecha FROM part""")
def sheet_spreads(spark, sf):
    """The two sheets to show for a match: one before if it is in the first third."""
    n = F.col("p_size")
    body = F.concat(F.repeat(F.lit("a"), F.when(n < 25, 10).otherwise(90)), F.lit("Héctor"), F.repeat(F.lit("b"), F.when(n < 25, 90).otherwise(10)))
    return read(spark, sf, "part").select("p_partkey", V.spread(F.col("p_partkey"), body, "hector").alias("s")).select("p_partkey", "s.izquierda", "s.derecha")


@query(f"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Héctor y ' || {_letters('p_partkey')} || ' · Catálogo de las naves' WHEN 1 THEN 'Catálogo de las naves' WHEN 2 THEN 'Canónico ' || CAST(p_partkey AS VARCHAR) ELSE 'Héctor y ' || {_letters('p_partkey')} END AS titulo,
 'Aquí están ' || {_letters('p_partkey')} || ' y Hector juntos.' AS descripcion FROM part""")
def passage_labels(spark, sf):
    """A title from names, section or work, or the volume's; the sentence with most of the names."""
    n = F.col("p_partkey")
    own = letters(n)
    names = F.array(F.lit("HÉCTOR"), own)
    section = F.when(n % 4 < 2, "Catálogo de las naves.").when(n % 4 == 2, "Libro XII").otherwise("Canto 4")
    shown = F.when((n % 4 == 0) | (n % 4 == 3), names).otherwise(F.array().cast("array<string>"))
    body = text("Una frase sin nombres pero bastante más larga que las demás de aquí. Aquí están ", own, " y Hector juntos. Solo ", own, ".")
    rows = read(spark, sf, "part")
    titled = V.described(body, section, F.lit("Canto I"), shown, text("Canónico ", n)).alias("t")
    return rows.select("p_partkey", titled, V.described(body, section, F.lit(""), names, F.lit("")).alias("d")).select("p_partkey", "t.titulo", "d.descripcion")


_SHA = "list_reduce(list_transform(string_split(sha1('2026-08-08'), ''), lambda c: CAST(strpos('0123456789abcdef', c) - 1 AS BIGINT)), lambda a, b: (a * 16 + b) % (hi - lo + 1), 0::BIGINT)"


@query(f"""WITH {CHUNKS}, w AS (SELECT *, len(regexp_extract_all(texto, '[^{_WS}]+')) AS p FROM chunks), e AS (SELECT min(id) AS lo, max(id) AS hi FROM w), d AS (SELECT {_SHA} + lo AS t, lo FROM e),
ok AS (SELECT id FROM w WHERE clase = 'obra' AND seccion = 'texto' AND p BETWEEN 110 AND 190),
a AS (SELECT id FROM ok, d WHERE id >= t ORDER BY id LIMIT 200), b AS (SELECT id FROM ok ORDER BY id LIMIT 200),
c AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS n FROM (SELECT id FROM a UNION ALL SELECT id FROM b WHERE NOT EXISTS (SELECT 1 FROM a)))
SELECT q.que, c.id, w.canonico FROM c JOIN d ON k = t % n JOIN w ON w.id = c.id, (VALUES ('sorteo'), ('mismo dia')) q(que)""")
def sticky_passage(spark, sf):
    """The passage of a day, thrown by the date, and the same when it is asked for again."""
    # The passages are cut once: each throw looks at the table several times.
    folder = work_path(spark, "passages")
    table(spark, sf).write.parquet(folder)
    rows = spark.read.parquet(folder).withColumn("nombres", F.lit(1)).withColumn("hojas", F.lit(0)).withColumn("titulo", F.lit(""))
    names, meta = spark.createDataFrame([], "canonico string, nombre string, normal string, refs string, cuantas int"), spark.createDataFrame([], schemas.META)
    first, meta = R.sticky_passage(rows, names, meta, "2026-08-08")
    again, _ = R.sticky_passage(rows, names, meta, "2026-08-08")
    return first.select(F.lit("sorteo").alias("que"), "id", "canonico").unionByName(again.select(F.lit("mismo dia").alias("que"), "id", "canonico"))


# --- names --------------------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT p_brand AS canonico, 'Don ' || p_name AS nombre, p_size + 1 AS a, p_partkey FROM part), r AS (SELECT canonico, nombre, CASE WHEN p_partkey % 3 = 0 THEN unnest(['IV ' || CAST(a AS VARCHAR), 'IV ' || CAST(a + 2 AS VARCHAR)]) ELSE unnest([CAST(a AS VARCHAR), CAST(a + 3 AS VARCHAR) || '-' || CAST(a + 5 AS VARCHAR)]) END AS ref FROM e)
SELECT canonico, nombre, string_agg(DISTINCT ref, '; ' ORDER BY ref) AS refs FROM r GROUP BY 1, 2""")
def index_of_names(spark, sf):
    """Each volume's index of names, read from its sheets: pages, ranges, and cantos that stand for what follows."""
    n = F.col("p_partkey")
    a = F.col("p_size") + 1
    entry = F.when(n % 3 == 0, text("Don ", F.col("p_name"), ", IV ", a, ", ", a + 2)).otherwise(text("Don ", F.col("p_name"), ", ", a, ", ", a + 3, " – ", a + 5))
    lines = read(spark, sf, "part").groupBy(F.col("p_brand").alias("canonico")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", entry.alias("t")))).alias("rows"))
    body = F.concat(F.lit("ÍNDICE DE NOMBRES\n"), F.array_join(F.transform("rows", lambda x: x["t"]), "\n"))
    front = lines.select("canonico", F.lit(1).alias("pdf"), F.lit("texto").alias("seccion"), F.lit("Aquiles canta, 7 veces.").alias("cuerpo"), F.lit("").alias("notas"))
    pages = front.unionByName(lines.select("canonico", F.lit(9).alias("pdf"), F.lit("texto").alias("seccion"), F.lit("").alias("cuerpo"), body.alias("notas")))
    return K.volume_names(pages).select("canonico", F.explode("indice_nombres").alias("nombre", "refs")).select("canonico", "nombre", F.array_join("refs", "; ").alias("refs"))


# --- text functions -----------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, trim(regexp_replace(strip_accents(lower(coalesce(text, ''))), '[{_WS}]+', ' ', 'g')) AS clave FROM documents")
def folded_texts(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.series_key(F.col("text")).alias("clave"))


@query("""SELECT p_partkey, 'fiesta ' || lower(p_name) AS compatible, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' ἄνδρα Ὅμηρος' || chr(10) || 'ανδρα Ομηρος' END AS busqueda, lower(p_name) || ' agora' AS igual FROM part""")
def greek_and_compat(spark, sf):
    """Compatibility characters written out, the searchable copy of Greek words, folds that keep positions."""
    register(spark)
    rows = read(spark, sf, "part").withColumn("g", F.when(F.col("p_partkey") % 2 == 0, text(F.col("p_name"), " ἄνδρα Ὅμηρος")).otherwise(F.col("p_name")))
    return rows.select("p_partkey", T.fold_compat(text("ﬁesta ", F.upper("p_name"))).alias("compatible"), T.greek_search_copy(F.col("g")).alias("busqueda"), F.call_function("quire_same_length_fold", text(F.upper("p_name"), " Ágora")).alias("igual"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 12.5 ELSE round((l_quantity * 2 - l_quantity) / (l_quantity * 2) * 100, 1) END::DOUBLE AS descuento, CASE WHEN l_linenumber % 3 = 0 THEN repeat('a', 500) ELSE repeat('a', 500) || ' corto' END AS texto,
 l_linenumber % 4 IN (1, 2) AS generico, l_linenumber % 4 IN (0, 3) AS varios FROM lineitem""")
def small_rules(spark, sf):
    """A discount worked out where none is said, recommendations cut off, links that are never an advertisement, titles that sell several volumes."""
    n = F.col("l_linenumber")
    percent = F.when(n % 2 == 0, 12.5)
    body = F.when(n % 3 == 0, F.lit("a" * 500 + "Te puede interesar: otro")).otherwise("a" * 500 + " corto")
    link = F.when(n % 4 == 1, "https://x.example/ayuda").when(n % 4 == 2, "https://x.example/api/libro~x1234567").when(n % 4 == 0, "https://x.example/libro~x1234567/ayuda").otherwise("https://x.example/libro")
    title = F.when(n % 4 == 0, "Ilíada, tomos I y II").when(n % 4 == 3, "Obras en 3 vols.").when(n % 4 == 1, "Ilíada I").otherwise("Diálogos")
    rows = read(spark, sf, "lineitem")
    cut = F.regexp_replace(T.cut_carousel(body), r"\s+$", "")
    return rows.select("l_orderkey", "l_linenumber", F.round(T.computed_discount(percent, F.col("l_quantity") * 2, F.col("l_quantity")), 1).alias("descuento"), cut.alias("texto"), T.generic_link(link).alias("generico"), M.sells_several(title).alias("varios"))


_CASES = [
    ("quire_searchable_name('Jenofonte - Anabasis (trad. Ramón Bach)_1982.pdf')", "Jenofonte Anabasis"),
    ("quire_section('Í N D I C E  D E  T O P Ó N I M O S')", "indice_nombres"),
    ("quire_section('Derechos de autor')", "portada"),
    ("cast(quire_mostly_greek('λόγος ab') as string)", "true"),
    ("array_join(transform(quire_greek_runs('el λόγος es'), x -> concat(x.texto, ':', x.griego)), '|')", "el :false|λόγος :true|es:false"),
    ("quire_join_hyphens('inter-\\nmedio\\nFin-\\nOtro')", "intermedio\nFin-\nOtro"),
    ("array_join(quire_chapter_marks(array(39, 2, 7, 40, 2)), ',')", "39,40"),
    ("quire_note_order('12b')", "000012b"),
    ("cast(quire_index_like('Aquiles, 12\\nHéctor, 13\\nAyante, 14\\nZeus, 15\\n12, 13\\nHera, 16\\nAres, 17\\nTetis, 18') as string)", "true"),
    ("array_join(quire_name_refs('III 189; VI 186, 190'), ',')", "III 189,VI 186,VI 190"),
    ("quire_code_page('compaρeros')", "compañeros"),
    ("cast(quire_figure_labels('ΑΒΓ ΑΒ ΔΕ λόγος') as string)", "2"),
    ("quire_tidy('uno  , dos\\n( tres )')", "uno, dos ( tres)"),
    ("cast(quire_margin_noise('b c d 94a') as string)", "true"),
    ("cast(quire_median_width('aaaaaaaa\\nbbbbbb\\ncc\\n\\nd') as string)", "4.0"),
    ("cast(quire_box_width('aaaaaaaa\\nbbbbbb\\ncc\\n\\nd') as string)", "6"),
    ("quire_without_foot('texto\\nLibro - Página 12')", "texto"),
    ("cast(quire_longest_common('a b c d', 'a c x d') as string)", "3"),
    ("array_join(quire_significant('Obras completas de Platón: Diálogos'), ',')", "platon,dialogos"),
    ("array_join(quire_roman_tokens('Libros XXI y XXV'), ',')", "xxi,xxv"),
    ("quire_text_title('Bajada de precio: Diálogos II', '')", "Diálogos II"),
    ("cast(quire_navigation('Cancelar tu suscripción') as string)", "true"),
    ("quire_compose('árbol')", "árbol"),
    ("cast(quire_book_count('lote de siete libros') as string)", "7"),
    ("cast(quire_several_volumes('Tomos I y II') as string)", "true"),
]


@query("SELECT p_partkey, " + ", ".join("'" + want.replace("'", "''") + f"' AS c{i}" for i, (_, want) in enumerate(_CASES)).replace("\n", "' || chr(10) || '") + ", 2::BIGINT AS segmentos FROM part")
def sql_functions(spark, sf):
    """The rules that are registered for SQL, called from SQL."""
    register(spark)
    read(spark, sf, "part").createOrReplaceTempView("quire_parts")
    cells = ", ".join(f"{call} AS c{i}" for i, (call, _) in enumerate(_CASES))
    return spark.sql(f"SELECT p_partkey, {cells}, (SELECT count(*) FROM quire_segments('Ilíada, Gredos\\ncorto\\nOdisea, Gredos; x')) AS segmentos FROM quire_parts")
