"""Queries of the alert store and the text functions over the driver's tables, each with its SQL.

Roles: events are price points (clave: the user, titulo: the kind, precio: value); purchases are lots.  orders are alerts.
Part names are advertisement titles, suppliers and nations are catalogue rows, pages are listings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import series as S

TEXTS = ("documents", "pages", "part")
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if table in TEXTS:
        # A small table in one file is one split; its texts are dealt to all cores.  Large tables have splits enough.
        cores = spark.sparkContext.defaultParallelism
        if len(rows.inputFiles()) < cores:
            return rows.repartition(cores)
    return rows


# --- roles ------------------------------------------------------------------------------------------------------------


def points(spark: SparkSession, sf: str) -> DataFrame:
    own = F.concat(F.col("event_type"), F.lit(" "), F.col("user_id").cast("string"))
    key = F.when(F.col("event_type") == "purchase", S.lot_key(own)).otherwise(S.series_key(own))
    mail = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("m"), (F.col("event_id") % 997).cast("string")))
    return read(spark, sf, "events").select(F.col("event_id").alias("id"), key.alias("clave"), own.alias("titulo"), F.col("ts").alias("fecha"), F.col("value").alias("precio"), F.concat(F.lit("https://x.example/lote/"), (F.col("user_id") % 50).cast("string"), F.lit("?utm=1")).alias("url"), mail.alias("mensaje_id"))


POINTS = """(SELECT event_id AS id, CASE WHEN event_type = 'purchase' THEN 'lote::' ELSE '' END || lower(event_type) || ' ' || CAST(user_id AS VARCHAR) AS clave,
 event_type || ' ' || CAST(user_id AS VARCHAR) AS titulo, ts AS fecha, value AS precio, 'https://x.example/lote/' || CAST(user_id % 50 AS VARCHAR) || '?utm=1' AS url,
 CASE WHEN event_id % 3 <> 0 THEN 'm' || CAST(event_id % 997 AS VARCHAR) END AS mensaje_id FROM events)"""


def history(spark: SparkSession, sf: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "notificado").when(F.col("o_orderstatus") == "O", "ignorado").otherwise("lote")
    return read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("fecha"), F.concat(F.lit("Título "), (F.col("o_custkey") % 200).cast("string")).alias("titulo"), F.col("o_totalprice").alias("precio_new"),
        F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") % 90).cast("double")).alias("descuento"), state.alias("estado"), F.concat(F.lit("m"), (F.col("o_orderkey") % 997).cast("string")).alias("mensaje_id"),
        F.concat(F.lit("https://x.example/lote/"), (F.col("o_custkey") % 60).cast("string")).alias("enlace"),
    )


HISTORY = """(SELECT o_orderkey AS id, o_orderdate AS fecha, 'Título ' || CAST(o_custkey % 200 AS VARCHAR) AS titulo, o_totalprice AS precio_new,
 CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 90 AS DOUBLE) END AS descuento,
 CASE o_orderstatus WHEN 'F' THEN 'notificado' WHEN 'O' THEN 'ignorado' ELSE 'lote' END AS estado, 'm' || CAST(o_orderkey % 997 AS VARCHAR) AS mensaje_id,
 'https://x.example/lote/' || CAST(o_custkey % 60 AS VARCHAR) AS enlace FROM orders)"""


# --- series -----------------------------------------------------------------------------------------------------------


@query(f"SELECT clave, arg_max(titulo, id) AS titulo, count(*) AS n, max(id) AS last_id FROM {POINTS} WHERE NOT starts_with(clave, 'lote::') GROUP BY clave")
def series_titles(spark, sf):
    return S.series_titles(points(spark, sf))


@query(f"SELECT clave, arg_max(titulo, id) AS titulo, count(*) AS n, max(id) AS last_id FROM {POINTS} WHERE starts_with(clave, 'lote::') GROUP BY clave")
def lot_titles(spark, sf):
    return S.series_titles(points(spark, sf), lots=True)


_STATS = "SELECT clave, count(*) AS n, min(precio) AS minimo, max(precio) AS maximo, max(fecha) AS fecha, arg_min(precio, id) AS primero, arg_max(precio, id) AS ultimo FROM {} WHERE {} GROUP BY clave"


@query(_STATS.format(POINTS, "NOT starts_with(clave, 'lote::')"))
def series_stats(spark, sf):
    return S.series_stats(points(spark, sf))


@query(_STATS.format(POINTS, "starts_with(clave, 'lote::')"))
def lot_stats(spark, sf):
    return S.series_stats(points(spark, sf), lots=True)


@query(f"SELECT clave, arg_max(precio, id) AS ultimo FROM {POINTS} GROUP BY clave")
def last_price(spark, sf):
    return S.last_prices(points(spark, sf))


@query(f"SELECT id, clave, anterior, precio FROM (SELECT *, lag(precio) OVER (PARTITION BY clave ORDER BY id) AS anterior FROM {POINTS}) WHERE precio > anterior")
def price_rise(spark, sf):
    return S.price_rises(points(spark, sf)).select("id", "clave", "anterior", "precio")


@query(f"SELECT id, clave, precio FROM (SELECT *, lag(precio) OVER (PARTITION BY clave ORDER BY id) AS b FROM {POINTS}) WHERE b IS NULL OR abs(precio - b) >= 0.01")
def insert_if_changed(spark, sf):
    return S.changed_points(points(spark, sf)).select("id", "clave", "precio")


@query(f"SELECT clave, n FROM (SELECT clave, count(*) OVER (PARTITION BY clave) AS n, row_number() OVER (PARTITION BY clave ORDER BY id DESC) AS r FROM {POINTS}) WHERE r = 1")
def series_counts(spark, sf):
    return S.series_titles(points(spark, sf)).select("clave", "n").unionByName(S.series_titles(points(spark, sf), True).select("clave", "n"))


@query(f"SELECT fecha, precio, url, id FROM {POINTS} WHERE clave = 'click 7'")
def series_points(spark, sf):
    return S.series_points(points(spark, sf), "click 7")


# --- alerts -----------------------------------------------------------------------------------------------------------


@query(f"""SELECT CAST(fecha AS DATE) AS dia, count(*) FILTER (WHERE estado = 'notificado') AS notificados, count(*) FILTER (WHERE estado = 'ignorado') AS ignorados,
 count(*) FILTER (WHERE estado = 'lote') AS lotes, first(titulo ORDER BY descuento DESC, id) FILTER (WHERE estado = 'notificado' AND descuento IS NOT NULL) AS mejor_titulo,
 max(descuento) FILTER (WHERE estado = 'notificado') AS mejor_descuento FROM {HISTORY} GROUP BY 1""")
def day_summary(spark, sf):
    return S.day_summary(history(spark, sf))


@query(f"SELECT * FROM {HISTORY} ORDER BY id DESC LIMIT 200")
def history_recent(spark, sf):
    return S.history_page(history(spark, sf))


@query(f"SELECT * FROM {HISTORY} WHERE estado = 'lote' ORDER BY id DESC LIMIT 1000")
def history_by_state(spark, sf):
    return S.history_page(history(spark, sf), 1000, "lote")


@query(f"""SELECT 'discount' AS modo, id FROM (SELECT id FROM {HISTORY} ORDER BY descuento DESC NULLS LAST, id DESC LIMIT 50)
UNION ALL SELECT 'cheapest', id FROM (SELECT id FROM {HISTORY} ORDER BY precio_new ASC NULLS LAST, id DESC LIMIT 50)
UNION ALL SELECT 'oldest', id FROM (SELECT id FROM {HISTORY} ORDER BY id LIMIT 50)
UNION ALL SELECT 'title', id FROM (SELECT id FROM {HISTORY} ORDER BY strip_accents(lower(titulo)), id DESC LIMIT 50)""")
def history_sorts(spark, sf):
    rows = history(spark, sf)
    parts = [rows.orderBy(*S.history_order(m)).limit(50).select(F.lit(m).alias("modo"), "id") for m in ("discount", "cheapest", "oldest", "title")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(f"""SELECT h.* FROM {HISTORY} h JOIN (SELECT id, row_number() OVER (ORDER BY id) AS r, count(*) OVER () AS n FROM {HISTORY}) k USING (id)
WHERE r > 500 * CAST(ceil(greatest(0, n - 1000) / 500.0) AS BIGINT)""")
def history_rotation(spark, sf):
    return S.rotated(history(spark, sf))


@query(f"SELECT id, titulo, precio_new FROM (SELECT * FROM {HISTORY} ORDER BY id DESC LIMIT 500) WHERE titulo = 'Título 5' ORDER BY id DESC LIMIT 3")
def last_alerts(spark, sf):
    return S.last_alerts(history(spark, sf), "Título 5").select("id", "titulo", "precio_new")


@query(f"SELECT * FROM {HISTORY} WHERE estado <> 'ignorado'")
def history_clear(spark, sf):
    return S.clear(history(spark, sf), "ignorado")


@query(f"""WITH h AS (SELECT id, 'm' || CAST(id % 9973 AS VARCHAR) AS mensaje_id, estado FROM {HISTORY})
SELECT id, mensaje_id, estado FROM (SELECT *, row_number() OVER (PARTITION BY mensaje_id, estado ORDER BY id) AS r FROM h WHERE id % 2 = 1) b
WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM h WHERE h.id % 2 = 0 AND h.mensaje_id = b.mensaje_id AND h.estado = b.estado)""")
def dedup_keep_first(spark, sf):
    """Alerts with even ids are stored; those with odd ids arrive."""
    rows = history(spark, sf).select("id", F.concat(F.lit("m"), (F.col("id") % 9973).cast("string")).alias("mensaje_id"), "estado")
    return S.new_alerts(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), "id")


@query(f"""WITH p AS {POINTS}, st AS (SELECT * FROM p WHERE id % 4 <> 1), b0 AS (SELECT * FROM p WHERE id % 4 = 1),
named AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clave, mensaje_id ORDER BY id) AS t FROM b0 WHERE mensaje_id IS NOT NULL) WHERE t = 1),
fresh AS (SELECT * FROM named n WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.clave = n.clave AND st.mensaje_id = n.mensaje_id)),
claims AS (SELECT *, row_number() OVER (PARTITION BY clave, precio, url ORDER BY id) AS k FROM fresh),
orphans AS (SELECT id, clave, precio, url, row_number() OVER (PARTITION BY clave, precio, url ORDER BY id) AS k FROM st WHERE mensaje_id IS NULL),
m AS (SELECT c.id, c.clave, c.precio, c.mensaje_id, o.id AS oid FROM claims c LEFT JOIN orphans o USING (clave, precio, url, k))
SELECT st.id, st.clave, st.precio, coalesce(st.mensaje_id, m.mensaje_id) AS mensaje_id FROM st LEFT JOIN m ON m.oid = st.id
UNION ALL SELECT id, clave, precio, mensaje_id FROM m WHERE oid IS NULL UNION ALL SELECT id, clave, precio, mensaje_id FROM b0 WHERE mensaje_id IS NULL""")
def adopt_orphans(spark, sf):
    rows = points(spark, sf)
    return S.add_points(rows.where("id % 4 <> 1"), rows.where("id % 4 = 1")).select("id", "clave", "precio", "mensaje_id")


@query(f"SELECT id, clave, precio FROM {POINTS} WHERE NOT (clave IN ('click 3', 'lote::purchase 3', 'view 9') AND regexp_replace(url, '[?#].*$', '') IN ('https://x.example/lote/3', 'https://x.example/lote/9'))")
def sold_retraction(spark, sf):
    sold = spark.createDataFrame([("click 3", "https://x.example/lote/3#a"), ("lote::purchase 3", "https://x.example/lote/3/"), ("view 9", "https://x.example/lote/9?z")], "clave string, url string")
    return S.retract_points(points(spark, sf), sold).select("id", "clave", "precio")


@query(f"SELECT CASE WHEN clave = 'lote::purchase 3' THEN 'lote::gran lote' ELSE clave END AS clave, count(*) AS n, CAST(sum(CAST(round(precio * 100) AS BIGINT)) AS BIGINT) AS centimos FROM {POINTS} GROUP BY 1")
def rename_lot(spark, sf):
    rows = points(spark, sf)
    lots = rows.select("titulo").limit(0)
    return S.rename_lot(rows, lots, "lote::purchase 3", "Gran  Lote")[0].groupBy("clave").agg(F.count("*").alias("n"), F.sum(F.round(F.col("precio") * 100).cast("long")).alias("centimos"))


@query(f"""WITH h AS {HISTORY} SELECT id, 'lote::' || strip_accents(lower(titulo)) AS clave, precio_new AS precio FROM h WHERE estado = 'lote' UNION ALL SELECT id, clave, precio FROM {POINTS}""")
def seed_lots(spark, sf):
    """The history's lots beside the points that are there; seeded a second time nothing is added."""
    first = S.seed_lots(points(spark, sf), history(spark, sf), False)
    return S.seed_lots(first, history(spark, sf), True).select("id", "clave", "precio")


@query(f"""WITH r AS (SELECT mensaje_id, 'historial' AS k, enlace AS url FROM {HISTORY} UNION ALL SELECT mensaje_id, CASE WHEN starts_with(clave, 'lote::') THEN 'lotes' ELSE 'precios' END, url FROM {POINTS}),
c AS (SELECT mensaje_id, regexp_replace(url, '[?#].*$', '') AS u, k FROM r WHERE mensaje_id IS NOT NULL)
SELECT mensaje_id, count(*) FILTER (WHERE k = 'historial') AS historial, count(*) FILTER (WHERE k = 'precios') AS precios, count(*) FILTER (WHERE k = 'lotes') AS lotes,
 count(DISTINCT u) FILTER (WHERE u IN (SELECT 'https://x.example/lote/' || CAST(i AS VARCHAR) FROM range(0, 20) t(i))) AS enlaces,
 count(DISTINCT u) FILTER (WHERE u IN (SELECT 'https://x.example/lote/' || CAST(i AS VARCHAR) FROM range(40, 60) t(i))) AS lotes_vigilados FROM c GROUP BY mensaje_id""")
def mail_footprint(spark, sf):
    watched = lambda a, b: spark.range(a, b).select(F.concat(F.lit("https://x.example/lote/"), F.col("id").cast("string"), F.lit("?c=1")).alias("url"))
    return S.mail_footprint(history(spark, sf), points(spark, sf), watched(0, 20), watched(40, 60))


@query("""WITH s AS (SELECT regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS u, page_id FROM pages WHERE url IS NOT NULL),
b AS (SELECT u, arg_max(CAST(page_id % 100 AS DOUBLE), page_id) AS p FROM s WHERE page_id % 2 = 1 AND u <> '' GROUP BY u), l AS (SELECT DISTINCT u FROM s WHERE page_id % 2 = 0)
SELECT coalesce(l.u, b.u) AS url, coalesce(b.p, CASE WHEN l.u IS NOT NULL THEN 1.0 END) AS ultimo_precio FROM l FULL JOIN b ON l.u = b.u""")
def watch_upsert(spark, sf):
    rows = read(spark, sf, "pages").where("url is not null")
    links = rows.where("page_id % 2 = 0").select(T.clean_url(F.col("url")).alias("url")).distinct().withColumn("ultimo_precio", F.lit(1.0))
    batch = rows.where("page_id % 2 = 1").select("url", (F.col("page_id") % 100).cast("double").alias("precio"), F.col("page_id").alias("seq"))
    return S.watch(links, batch, owner=None)


@query("SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_orderkey % 50 <> 0 THEN l_extendedprice END AS ultimo_precio, l_orderkey % 50 = 0 AS vendido FROM lineitem")
def mark_sold(spark, sf):
    rows = read(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_extendedprice").alias("ultimo_precio"), F.lit(False).alias("vendido"))
    return S.mark_sold(rows, read(spark, sf, "lineitem").where("l_orderkey % 50 = 0").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")))


# --- thresholds, tables -------------------------------------------------------------------------------------------------

PATTERNS = [("ring", 25.0), ("red", 10.0), ("Blue", 50.0), ("a", 5.0), ("red widget", 70.0), ("  ", 1.0), ("widget", 12.5)]
_PATTERNS = "(VALUES " + ", ".join(f"('{p}', {v}, {i})" for i, (p, v) in enumerate(PATTERNS)) + ") t(patron, porcentaje, seq)"


@query(f"""WITH t AS (SELECT trim(patron) AS patron, CAST(arg_max(porcentaje, seq) AS DOUBLE) AS porcentaje FROM {_PATTERNS} WHERE trim(patron) <> '' GROUP BY 1)
SELECT p_partkey, first(porcentaje ORDER BY length(patron) DESC, lower(patron)) FILTER (WHERE contains(lower(p_name), lower(patron))) AS porcentaje FROM part, t GROUP BY p_partkey""")
def threshold_longest(spark, sf):
    rows = spark.createDataFrame([(p, v, i) for i, (p, v) in enumerate(PATTERNS)], "patron string, porcentaje double, seq int")
    return S.thresholds_for(read(spark, sf, "part"), S.set_thresholds(rows), "p_name").select("p_partkey", "porcentaje")


@query("""SELECT 'k' || CAST(user_id % 90 AS VARCHAR) AS clave, coalesce(arg_max(event_type, event_id) FILTER (WHERE user_id % 90 < 60 AND event_id % 3 = 0), 'viejo ' || max(event_type)) AS valor FROM events GROUP BY user_id % 90""")
def meta_upsert(spark, sf):
    """A table of keys after a batch: the batch's last value of a key, and the old one of keys that it doesn't have."""
    rows = read(spark, sf, "events").select(F.concat(F.lit("k"), (F.col("user_id") % 90).cast("string")).alias("clave"), F.col("event_type").alias("valor"), F.col("event_id").alias("seq"), (F.col("user_id") % 90).alias("k"))
    old = rows.groupBy("clave").agg(F.concat(F.lit("viejo "), F.max("valor")).alias("valor"))
    return S.put_meta(old, rows.where("k < 60 and seq % 3 = 0"))


@query("SELECT event_type AS folder, max(TRY_CAST(CASE WHEN event_id % 11 = 0 THEN 'x' ELSE CAST(event_id AS VARCHAR) END AS BIGINT)) AS ultimo FROM events GROUP BY 1")
def last_uid(spark, sf):
    rows = read(spark, sf, "events").select(F.col("event_type").alias("folder"), F.when(F.col("event_id") % 11 == 0, "x").otherwise(F.col("event_id").cast("string")).alias("uid"))
    return S.last_uid(S.mark_processed(rows.limit(0), rows))


@query("SELECT folder, uid FROM (SELECT DISTINCT event_type AS folder, CAST(user_id AS VARCHAR) AS uid FROM events)")
def mark_processed(spark, sf):
    rows = read(spark, sf, "events").select(F.col("event_type").alias("folder"), F.col("user_id").cast("string").alias("uid"))
    return S.mark_processed(rows.where("uid = '7'"), rows)


@query("""SELECT s.s_suppkey AS numero, s.s_name AS autor, s.s_suppkey % 3 = 0 AS poseido, s.s_suppkey % 5 = 0 AS deseado,
 CASE WHEN s.s_suppkey % 2 = 0 THEN s.s_acctbal END AS precio_objetivo FROM supplier s""")
def catalog_reload(spark, sf):
    rows = read(spark, sf, "supplier")
    none = F.lit(None).cast("string")
    old = rows.select(F.col("s_suppkey").alias("numero"), F.col("s_nationkey").alias("orden"), (F.col("s_suppkey") % 3 == 0).alias("poseido"), (F.col("s_suppkey") % 5 == 0).alias("deseado"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal")).alias("precio_objetivo"), none.alias("descripcion"), none.alias("temas"))
    return S.reload_catalogue(old, rows.select(F.col("s_suppkey").alias("numero"), F.col("s_name").alias("autor"))).select("numero", "autor", "poseido", "deseado", "precio_objetivo")


@query("SELECT n_regionkey AS orden, CAST(min(n_nationkey) AS VARCHAR) AS numero FROM nation GROUP BY 1")
def order_resolver(spark, sf):
    rows = read(spark, sf, "nation").select(F.col("n_regionkey").alias("orden"), F.col("n_nationkey").cast("string").alias("numero"), F.col("n_nationkey").alias("fila"))
    return S.first_number(rows)


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = c_nationkey % 5) ELSE c_nationkey END AS numero FROM customer")
def backfill_links(spark, sf):
    links = read(spark, sf, "customer").select("c_custkey", (F.col("c_nationkey") % 5).alias("orden"), F.when(F.col("c_custkey") % 2 == 1, F.col("c_nationkey")).alias("numero"))
    rows = read(spark, sf, "nation").select(F.col("n_regionkey").alias("orden"), F.col("n_nationkey").alias("numero"), F.col("n_nationkey").alias("fila"))
    return S.backfill_links(links, rows).select("c_custkey", "numero")


@query("SELECT s_suppkey, s_nationkey FROM supplier ORDER BY s_nationkey NULLS LAST, s_suppkey")
def catalog_order(spark, sf):
    rows = read(spark, sf, "supplier").select("s_suppkey", "s_nationkey", F.col("s_nationkey").alias("orden"), F.col("s_suppkey").alias("fila"))
    return rows.orderBy(*S.catalogue_order()).select("s_suppkey", "s_nationkey")


_FIELDS = {"p_name": 6.0, "p_brand": 4.0, "p_type": 3.0}
_WORDS = ["wid", "econ"]


def _field_score() -> str:
    parts = []
    for c, w in _FIELDS.items():
        for x in _WORDS:
            parts.append(f"CASE WHEN contains(lower({c}), '{x}') THEN CASE WHEN list_contains(regexp_split_to_array(trim(lower({c})), '\\s+'), '{x}') THEN {w * 1.6} ELSE {w} END ELSE 0.0 END")
    return " + ".join(parts)


@query(f"""SELECT p_partkey, round(CAST({_field_score()} AS DOUBLE), 6) AS puntos FROM part WHERE {' AND '.join(f"contains(lower(p_name || ' ' || p_brand || ' ' || p_type), '{x}')" for x in _WORDS)} ORDER BY puntos DESC, p_partkey LIMIT 200""")
def catalog_keyword_search(spark, sf):
    found = S.search_catalogue(read(spark, sf, "part"), " ".join(_WORDS), _FIELDS, 200, [F.asc("p_partkey")])
    return found.select("p_partkey", F.round("puntos", 6).alias("puntos"))


# --- text functions -----------------------------------------------------------------------------------------------------


@query("SELECT page_id, regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '/+$', '') AS limpia FROM pages WHERE url IS NOT NULL")
def clean_url(spark, sf):
    return read(spark, sf, "pages").where("url is not null").select("page_id", T.clean_url(F.col("url")).alias("limpia"))


@query("""SELECT page_id, upper(w[1:1]) || w[2:] AS titulo FROM (SELECT page_id, trim(translate(regexp_replace(regexp_replace(regexp_extract(regexp_replace(url_decode(replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '+', '%2B')), '/+$', ''), '([^/]*)$', 1), '~x[0-9]+$', ''), '-[0-9]{6,}$', ''), '-_', '  ')) AS w FROM pages WHERE url IS NOT NULL)""")
def url_slug_title(spark, sf):
    return read(spark, sf, "pages").where("url is not null").select("page_id", T.slug_title(F.col("url")).alias("titulo"))


@query("SELECT l_orderkey, l_linenumber, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '~x([0-9]{6,})', 1))), ',') AS ids FROM (SELECT *, 'a~x' || CAST(1000000 + l_partkey AS VARCHAR) || ' b~x' || CAST(1000000 + l_suppkey AS VARCHAR) || ' c~x12' AS t FROM lineitem)")
def ad_ids(spark, sf):
    n = lambda c: (F.col(c) + 1_000_000).cast("string")
    text = F.concat(F.lit("a~x"), n("l_partkey"), F.lit(" b~x"), n("l_suppkey"), F.lit(" c~x12"))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(F.sort_array(T.ad_ids(text)), ",").alias("ids"))


def _mail_text() -> F.Column:
    cents = lambda c: F.replace(F.format_string("%.2f", F.col(c)), F.lit("."), F.lit(","))
    return F.concat(F.lit("Antes "), cents("l_extendedprice"), F.lit(" €, ahora "), cents("l_quantity"), F.lit(" euros. Precio actual: "), F.col("l_linenumber").cast("string"), F.lit(",50 €. Descuento del "), F.col("l_suppkey").cast("string"), F.lit("% o ¡"), F.col("l_linenumber").cast("string"), F.lit("% de descuento!"))


_MAIL = "'Antes ' || replace(printf('%.2f', l_extendedprice), '.', ',') || ' €, ahora ' || replace(printf('%.2f', l_quantity), '.', ',') || ' euros. Precio actual: ' || l_linenumber || ',50 €. Descuento del ' || l_suppkey || '% o ¡' || l_linenumber || '% de descuento!'"
_KEY = "l_orderkey, l_linenumber"


@query(f"SELECT {_KEY}, l_extendedprice AS primero, CAST(l_quantity AS DOUBLE) AS segundo, 3::INT AS n, CAST(l_linenumber + 0.5 AS DOUBLE) AS actual FROM lineitem")
def price_regex(spark, sf):
    rows = read(spark, sf, "lineitem").withColumn("a", T.amounts(_mail_text()))
    return rows.select("l_orderkey", "l_linenumber", F.col("a")[0].alias("primero"), F.col("a")[1].alias("segundo"), F.size("a").alias("n"), T.current_price(_mail_text()).alias("actual"))


@query(f"SELECT {_KEY}, CASE WHEN l_suppkey BETWEEN 1 AND 100 THEN CAST(l_suppkey AS DOUBLE) ELSE CAST(l_linenumber AS DOUBLE) END AS percent, CASE WHEN l_suppkey BETWEEN 1 AND 100 THEN 'header' ELSE 'phrase' END AS source FROM lineitem")
def discount_cascade(spark, sf):
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.discount(_mail_text()).alias("d")).select("l_orderkey", "l_linenumber", "d.percent", "d.source")


@query(f"""SELECT {_KEY}, o IS NULL OR o <= 0 OR abs((o - l_quantity) / o * 100 - p) <= 3.0 AS cuadra, (o IS NULL OR o <= 0 OR abs((o - l_quantity) / o * 100 - p) <= 3.0) AND o IS NOT NULL AS fiable
FROM (SELECT *, CASE WHEN l_partkey % 9 <> 0 THEN l_quantity * 2 END AS o, 40.0 + l_linenumber * 3 AS p FROM lineitem)""")
def coherence(spark, sf):
    rows = read(spark, sf, "lineitem").withColumn("o", F.when(F.col("l_partkey") % 9 != 0, F.col("l_quantity") * 2)).withColumn("p", 40.0 + F.col("l_linenumber") * 3)
    fits = T.coherent(F.col("o"), F.col("l_quantity"), F.col("p"))
    return rows.select("l_orderkey", "l_linenumber", fits.alias("cuadra"), T.reliable(F.col("o"), F.col("l_quantity"), F.col("p"), F.lit("regex"), F.lit(False)).alias("fiable"))


@query(f"""SELECT {_KEY}, l_partkey % 5 <> 0 AND (o IS NULL OR abs((o - l_quantity) / o * 100 - p) <= 3.0) AND (o IS NOT NULL OR l_linenumber % 4 <> 2) AS fiable FROM (SELECT *, CASE WHEN l_partkey % 3 <> 0 THEN l_quantity * 2 END AS o, 44.0 + l_linenumber * 2 AS p FROM lineitem)""")
def reliability(spark, sf):
    """Whether an alert is to be trusted: one advertisement, prices that agree, and both prices or a percentage that the mail states in words."""
    source = F.element_at(F.array(*map(F.lit, ("header", "phrase", "regex", "computed"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    old = F.when(F.col("l_partkey") % 3 != 0, F.col("l_quantity") * 2)
    fits = T.reliable(old, F.col("l_quantity"), 44.0 + F.col("l_linenumber") * 2, source, F.col("l_partkey") % 5 == 0)
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", fits.alias("fiable"))


@query(f"SELECT {_KEY}, round(CAST(25 * (l_partkey % 2) + 20 * (l_partkey % 3 // 2) + 20 + 20 * (l_suppkey % 2) + 15 * (l_linenumber % 2) AS DOUBLE) / 100, 2) AS confianza FROM lineitem")
def confidence(spark, sf):
    has = {"link": F.col("l_partkey") % 2 == 1, "old_price": F.col("l_partkey") % 3 == 2, "new_price": F.lit(True), "percent": F.col("l_suppkey") % 2 == 1, "title": F.col("l_linenumber") % 2 == 1}
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.confidence(has).alias("confianza"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN CASE WHEN p_size BETWEEN 2 AND 150 THEN p_size ELSE 0 END WHEN 1 THEN 7 WHEN 2 THEN CASE WHEN p_size BETWEEN 2 AND 150 THEN p_size ELSE 0 END ELSE 0 END AS libros FROM part")
def book_count(spark, sf):
    n = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("LOTE DE "), n, F.lit(" LIBROS y 99 tomos"))).when(F.col("p_size") % 4 == 1, F.lit("lote de siete libros")).when(F.col("p_size") % 4 == 2, F.concat(F.lit("obra en "), n, F.lit(" vols. de piel"))).otherwise(F.lit("anales, libros I-VI, 1983 libros"))
    return read(spark, sf, "part").select("p_partkey", T.book_count(text).alias("libros"))


@query("SELECT doc_id FROM documents WHERE contains(strip_accents(lower(text)), 'etre')")
def normalised_search(spark, sf):
    return read(spark, sf, "documents").where(F.contains(T.fold(F.col("text")), F.lit("etre"))).select("doc_id")


@query(f"SELECT {_KEY}, CASE WHEN l_quantity = floor(l_quantity) THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' €' ELSE replace(printf('%.2f', l_quantity), '.', ',') || ' €' END AS cantidad, replace(printf('%.2f', l_extendedprice + 0.25), '.', ',') || ' €' AS precio FROM lineitem WHERE l_extendedprice + 0.25 <> floor(l_extendedprice + 0.25)")
def price_format(spark, sf):
    rows = read(spark, sf, "lineitem").withColumn("p", F.col("l_extendedprice") + 0.25).where("p <> floor(p)")
    return rows.select("l_orderkey", "l_linenumber", T.format_price(F.col("l_quantity")).alias("cantidad"), T.format_price(F.col("p")).alias("precio"))


@query(f"SELECT {_KEY}, l_linenumber % 3 = 0 AS aviso FROM lineitem")
def relevance(spark, sf):
    subject = F.when(F.col("l_linenumber") % 3 == 0, "Bajada de precio en tu artículo").when(F.col("l_linenumber") % 3 == 1, "Haz una oferta: descuento").otherwise("Diálogos II")
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.price_alert(subject, F.lit("60 % de coleccionistas")).alias("aviso"))


@query(f"SELECT {_KEY}, CASE l_linenumber % 4 WHEN 0 THEN 'agotado' WHEN 1 THEN 'venta' ELSE '' END AS estado, l_linenumber % 4 = 0 OR l_linenumber % 4 = 2 AS vendido FROM lineitem")
def listing_state(spark, sf):
    k = F.col("l_linenumber") % 4
    page = F.when(k == 0, '"availability":"https://schema.org/SoldOut"').when(k == 1, '<link itemprop="availability" href="https://schema.org/InStock">').otherwise("<p>nada</p>")
    own = F.when(k == 2, "Este artículo ya no está disponible").otherwise("en venta")
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.availability(page).alias("estado"), T.listing_sold(page, own).alias("vendido"))


@query()
def html_text(spark, sf):
    from quire.functions.mail import html_text as parse

    return read(spark, sf, "pages").select("page_id", parse(F.col("html")).alias("t")).select("page_id", "t.text", F.size("t.links").alias("n_links"))


@query()
def text_quality(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.text_quality(F.coalesce("text", F.lit(""))).alias("q")).select("doc_id", "q.state", F.round("q.legible", 6).alias("legible"))
