"""Queries of resolution, composition, corpus analysis, mails and the stream over the driver's tables.

Documents are pages (the source is the volume), parts are catalogue rows and titles, line items stand for layout numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import pages as P
from quire.operators import corpus as K
from quire.operators import resolve as R
from quire.operators import search as Q
from quire.operators import series as S
from quire.plans.store_queries import POINTS, points, read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def catalogue(spark, sf) -> DataFrame:
    """The first part of each brand and type as a volume."""
    first = read(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("fila"), F.min_by("p_name", "p_partkey").alias("obras"))
    return first.select("fila", F.col("fila").cast("int").alias("orden"), F.col("fila").cast("string").alias("numero"), F.concat(F.col("p_type"), F.lit(" "), F.col("p_brand")).alias("autor"), "obras", F.lit(0).alias("paginas"), F.lit("").alias("notas"))


def pages(spark, sf) -> DataFrame:
    return read(spark, sf, "documents").where("doc_id is not null").select(F.col("source").alias("canonico"), F.col("doc_id").cast("int").alias("pdf"), F.lit("texto").alias("seccion"), F.lit("").alias("titulo"), F.col("lang").alias("obra"), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("1"))).otherwise(F.array()).alias("versos"), F.col("text").alias("cuerpo"), F.lit("").alias("notas"))


# --- resolution ---------------------------------------------------------------------------------------------------------


@query()
def fuzzy_resolve(spark, sf):
    titles = read(spark, sf, "part").select("p_partkey", F.concat(F.col("p_type"), F.lit(" "), F.col("p_brand"), F.lit(". "), F.col("p_name"), F.lit(" edición antigua")).alias("titulo"))
    return R.resolve(titles, catalogue(spark, sf)).select("p_partkey", "fila", F.round("puntos", 6).alias("puntos"))


@query()
def resolve_many(spark, sf):
    lots = read(spark, sf, "part").groupBy(F.floor(F.col("p_partkey") / 100).alias("lote")).agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.col("p_type"), F.lit(" "), F.col("p_brand"), F.lit(" - "), F.col("p_name")))), "\n").alias("texto"))
    return R.resolve_many(lots, catalogue(spark, sf), "lote", "texto")


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'Tragedias' WHEN 1 THEN 'Discursos' ELSE 'Moralia varia' END AS base,
 CASE l_linenumber % 3 WHEN 0 THEN 'II' WHEN 1 THEN 'XXXVI-LX' ELSE '' END AS volumen FROM lineitem""")
def split_volumes(spark, sf):
    n = F.col("l_linenumber") % 3
    text = F.when(n == 0, "Tragedias II").when(n == 1, "Discursos XXXVI-LX").otherwise("Moralia varia")
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", R.split_volume(text).alias("v")).select("l_orderkey", "l_linenumber", "v.*")


@query("""WITH r AS (SELECT s_suppkey AS fila, s_nationkey AS orden, 'Vol. ' || CASE s_suppkey % 3 WHEN 0 THEN 'I' WHEN 1 THEN 'II' ELSE 'III' END AS h, s_nationkey % 4 AS g FROM supplier),
m AS (SELECT *, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g, h ORDER BY fila) AS t FROM r)
SELECT fila, CASE WHEN n = 1 THEN '' WHEN t = 1 THEN h ELSE 'nº ' || CAST(orden AS VARCHAR) END AS sufijo, CASE WHEN n = 1 THEN '' ELSE 'Historia' END AS titulo_base FROM m""")
def annotate_ambiguous(spark, sf):
    n = F.col("s_suppkey") % 3
    rows = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("fila"), F.col("s_nationkey").alias("orden"), F.concat(F.lit("Autor "), (F.col("s_nationkey") % 4).cast("string")).alias("autor"), F.concat(F.lit("Historia "), F.when(n == 0, "I").when(n == 1, "II").otherwise("III")).alias("obras"), F.lit("").alias("notas"))
    return R.annotate(rows).select("fila", "sufijo", "titulo_base")


@query("SELECT p_partkey, p_size BETWEEN 36 AND 41 AS raro, p_size BETWEEN 42 AND 43 AS apendice FROM (SELECT p_partkey, p_size FROM part)")
def rare_volumes(spark, sf):
    order = F.when(F.col("p_size").between(36, 41), F.col("p_size") * 10).when(F.col("p_size").between(42, 43), F.col("p_size") - 42 + 416).otherwise(1)
    return read(spark, sf, "part").select("p_partkey", R.is_rare(order).alias("raro"), R.is_appendix(order).alias("apendice"))


# --- sections and layout ------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey < 50 THEN 'portada' WHEN l_partkey < 120 THEN 'introduccion' WHEN l_partkey < 1500 THEN 'texto' ELSE 'notas_finales' END AS seccion FROM lineitem""")
def section_range_join(spark, sf):
    parts = spark.createDataFrame([("d", 0, 49, "portada", "p"), ("d", 50, 119, "introduccion", "i"), ("d", 120, 1499, "texto", "t"), ("d", 1400, None, "notas_finales", "n")], "doc string, desde int, hasta int, tipo string, titulo string")
    rows = read(spark, sf, "lineitem").select(F.lit("d").alias("doc"), F.col("l_partkey").cast("int").alias("pdf"), "l_orderkey", "l_linenumber")
    # The last section goes on to the volume's last sheet.
    parts = parts.join(rows.groupBy("doc").agg(F.max("pdf").alias("ultima")), "doc").select("doc", "desde", F.coalesce("hasta", "ultima").alias("hasta"), "tipo", "titulo")
    return K.section_of(rows, parts).select("l_orderkey", "l_linenumber", "seccion")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey < 10 THEN '' WHEN l_partkey < 80 THEN 'A' WHEN l_partkey < 700 THEN 'B' ELSE 'C' END AS obra FROM lineitem")
def work_as_of_join(spark, sf):
    works = spark.createDataFrame([("d", 10, "A"), ("d", 80, "B"), ("d", 700, "C")], "doc string, page int, title string")
    rows = read(spark, sf, "lineitem").select(F.lit("d").alias("doc"), F.col("l_partkey").cast("int").alias("pdf"), "l_orderkey", "l_linenumber")
    return K.work_of(rows, works).select("l_orderkey", "l_linenumber", "obra")


@query("""WITH s AS (SELECT user_id AS doc, event_id AS desde, event_type IN ('error', 'signup') AS tail FROM events), l AS (SELECT doc, max(desde) FILTER (WHERE NOT tail) AS last FROM s GROUP BY doc)
SELECT CAST(s.doc AS VARCHAR) AS doc, CAST(coalesce(min(desde) FILTER (WHERE tail AND desde > coalesce(last, -1)) - 1, 1000000) AS INT) AS hojas FROM s JOIN l USING (doc) GROUP BY s.doc""")
def text_sheets(spark, sf):
    kind = F.when(F.col("event_type") == "error", "notas_finales").when(F.col("event_type") == "signup", "indice_nombres").otherwise("texto")
    parts = read(spark, sf, "events").select(F.col("user_id").cast("string").alias("doc"), F.col("event_id").cast("int").alias("desde"), F.col("event_id").cast("int").alias("hasta"), kind.alias("tipo"), F.lit("").alias("titulo"))
    counts = parts.select("doc").distinct().withColumn("pages", F.lit(1_000_000))
    return K.text_sheets(parts, counts)


def _spans(spark, sf) -> DataFrame:
    """Line items as layout: an order is a sheet of its supplier's volume."""
    return read(spark, sf, "lineitem").select((F.col("l_suppkey") % 20).cast("string").alias("doc"), (F.col("l_orderkey") % 300).cast("int").alias("page"), F.col("l_linenumber").cast("int").alias("block"), F.lit(0).alias("line"), F.lit(40.0).alias("x0"), (F.col("l_linenumber") * 90.0).alias("y0"), F.lit(300.0).alias("x1"), F.lit(0.0).alias("y1"), (8 + F.col("l_linenumber") % 3).cast("double").alias("size"), F.concat(F.lit("texto "), F.col("l_returnflag"), F.lit(" "), F.col("l_linestatus")).alias("text"))


@query("""WITH s AS (SELECT CAST(l_suppkey % 20 AS VARCHAR) AS doc, round(CAST(8 + l_linenumber % 3 AS DOUBLE), 1) AS size, sum(length('texto ' || l_returnflag || ' ' || l_linestatus)) AS n, min((l_orderkey % 300) * 100 + l_linenumber) AS f FROM lineitem GROUP BY 1, 2)
SELECT doc, first(size ORDER BY n DESC, f) AS size FROM s GROUP BY doc""")
def dominant_size(spark, sf):
    return K.dominant_size(_spans(spark, sf), ["doc"])


@query()
def note_thresholds(spark, sf):
    return K.note_threshold(_spans(spark, sf))


@query()
def page_records(spark, sf):
    spans = _spans(spark, sf)
    boxes = spans.select("doc", "page").distinct().select("*", F.lit(400.0).alias("width"), F.lit(600.0).alias("height"))
    toc = spans.groupBy("doc").agg(F.min("page").alias("page")).select("doc", F.lit(1).alias("level"), F.lit("Obra").alias("title"), (F.col("page") + 6).alias("page"))
    return K.page_records(spans, boxes, toc).select("canonico", "pdf", "seccion", "obra", "cuerpo", "notas")


@query("SELECT l_orderkey, l_linenumber, l_quantity < 10 AND l_discount > 0.04 AS escaneada, CASE WHEN l_quantity > 0 THEN (l_quantity - l_linenumber) / l_quantity * 100 ELSE 0.0 END AS cobertura FROM lineitem")
def scanned_sheets(spark, sf):
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", K.scanned(F.col("l_quantity") * 10, F.col("l_discount") * 10).alias("escaneada"), K.coverage(F.col("l_quantity"), F.col("l_linenumber")).alias("cobertura"))


# --- text of pages ------------------------------------------------------------------------------------------------------


@query()
def page_composition(spark, sf):
    return pages(spark, sf).select("canonico", "pdf", P.composed(F.coalesce("cuerpo", F.lit("")), F.col("notas")).alias("p")).select("canonico", "pdf", "p.es_verso", F.size("p.bloques").alias("bloques"), F.size("p.marcas").alias("marcas"), F.size("p.llamadas").alias("llamadas"))


@query()
def composition_report(spark, sf):
    return K.composition_report(pages(spark, sf))


@query()
def suspicious_pages(spark, sf):
    return K.suspicious_pages(pages(spark, sf))


@query()
def volume_totals(spark, sf):
    return K.volume_totals(pages(spark, sf)).select("canonico", "hojas", "palabras", "cuerpo", "notas", "estado")


@query()
def corpus_repair(spark, sf):
    return K.repair(K.unfold_notes(pages(spark, sf))).select("canonico", "pdf", F.length("cuerpo").alias("chars"))


@query("""WITH p AS (SELECT source AS canonico, doc_id AS pdf, lang AS work, doc_id % 3 = 0 AS m, CASE doc_id % 5 WHEN 1 THEN 'Sinopsis' WHEN 2 THEN 'Acto' ELSE '' END AS t FROM documents WHERE doc_id IS NOT NULL),
w AS (SELECT *, row_number() OVER (PARTITION BY canonico, work ORDER BY pdf) - 1 AS place, sum(CAST(m AS INT)) OVER (PARTITION BY canonico, work ORDER BY pdf ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS s FROM p),
f AS (SELECT canonico, work, min(place) AS frontier FROM w WHERE m AND s >= 4 AND place < 80 GROUP BY ALL)
SELECT canonico, CAST(pdf AS INT) AS pdf FROM w JOIN f USING (canonico, work) WHERE place < frontier AND NOT m AND t = 'Sinopsis'""")
def preliminaries(spark, sf):
    title = F.when(F.col("pdf") % 5 == 1, "Sinopsis").when(F.col("pdf") % 5 == 2, "Acto").otherwise("")
    return Q.preliminaries(pages(spark, sf).withColumn("titulo", title))


@query("""WITH l AS (SELECT doc_id, list_sort(list_transform(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\s\\x0B\\x{A0}]')), lambda x: length(regexp_replace(x, '^[\\s\\x0B\\x{A0}]+|[\\s\\x0B\\x{A0}]+$', '', 'g')))) AS s FROM documents WHERE doc_id IS NOT NULL)
SELECT CAST(doc_id AS INT) AS pdf, CAST(CASE WHEN len(s) = 0 THEN NULL WHEN len(s) % 2 = 1 THEN s[(len(s) + 1) // 2] ELSE (s[len(s) // 2] + s[len(s) // 2 + 1]) / 2 END AS DOUBLE) AS mediana FROM l""")
def median_line(spark, sf):
    return pages(spark, sf).select("pdf", K.median_line(F.coalesce("cuerpo", F.lit(""))).alias("mediana"))


# --- mails and the stream -------------------------------------------------------------------------------------------------


@query()
def parse_mails(spark, sf):
    """The pages' HTML as mails."""
    from quire.functions.mail import SHOP, parse_mail

    head = F.concat(F.lit(f"From: x@{SHOP}.net\nSubject: Bajada de precio\nMessage-ID: <"), F.col("page_id").cast("string"), F.lit("@x>\nContent-Type: text/html; charset=utf-8\n\n"), F.coalesce("html", F.lit("")))
    mails = read(spark, sf, "pages").select("page_id", parse_mail(F.encode(head, "UTF-8")).alias("m"))
    return mails.select("page_id", "m.message_key", "m.alert.title", "m.alert.new_price", "m.alert.discount_percent", "m.alert.confidence", "m.error")


@query(f"""SELECT mensaje_id, estado, id FROM (SELECT 'm' || CAST(o_orderkey % 997 AS VARCHAR) AS mensaje_id, CASE WHEN o_totalprice > 100000 THEN 'notificado' ELSE 'ignorado' END AS estado, min(o_orderkey) AS id FROM orders GROUP BY 1, 2)""")
def stream_monitor(spark, sf):
    """Alerts arriving in two batches, the second with all of the first again: every alert is stored once."""
    rows = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("m"), (F.col("o_orderkey") % 997).cast("string")).alias("mensaje_id"), F.when(F.col("o_totalprice") > 100000, "notificado").otherwise("ignorado").alias("estado"))
    middle = rows.agg(F.avg("id")).collect()[0][0]
    first = S.new_alerts(rows.limit(0), rows.where(F.col("id") <= middle), "id")
    return first.unionByName(S.new_alerts(first, rows, "id").select(first.columns)).select("mensaje_id", "estado", "id")


@query(f"SELECT clave, count(*) AS n FROM {POINTS} WHERE starts_with(clave, 'lote::') GROUP BY clave UNION ALL SELECT 'lote::sin puntos', 0")
def lots_without_points(spark, sf):
    own = S.series_titles(points(spark, sf), lots=True)
    lots = own.select("titulo").unionByName(spark.createDataFrame([("Sin  puntos",)], "titulo string"))
    return S.lots_without_points(own, lots).select("clave", "n")
