"""Queries of mails, files, the stream, watch lists and views of the collection over the driver's tables, each with its SQL.

Mails, listings and volumes are made from rows by a template, so the SQL states what must be read back from the row itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import schemas
from quire.functions import mail as M
from quire.functions import text as T
from quire.operators import corpus as K
from quire.operators import resolve as R
from quire.operators import series as S
from quire.operators import views as V
from quire.operators.index_store import Store as IndexStore
from quire.operators.index_store import alphabetical, joined_names
from quire.plans.search_queries import CHUNKS
from quire.plans.store_queries import HISTORY, history, read
from quire.session import spread, work_path
from quire.sources import tables as X
from quire.streaming import monitor as W
from quire.streaming import prices as P

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def letters(n: Column) -> Column:
    """A number as a word that no other such word contains."""
    return F.concat(F.lit("q"), F.translate(F.lpad(n.cast("string"), 9, "0"), "0123456789", "bcdfghjklm"), F.lit("z"))


def _letters(n: str) -> str:
    return f"('q' || translate(lpad(CAST({n} AS VARCHAR), 9, '0'), '0123456789', 'bcdfghjklm') || 'z')"


def text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


# --- mails --------------------------------------------------------------------------------------------------------------

_FROM, _DATE = f"Avisos <no-reply@{M.SHOP}.net>", "Fri, 07 Aug 2026 10:00:00 +0200"


def mails(rows: DataFrame, n: Column) -> DataFrame:
    """rows with `raw`, a mail: by n as HTML or, where n % 7 = 3, as plain text; every fifth without Message-ID, every third encoded."""
    new = n % 50 + 10
    title = text("Obra ", letters(n))
    subject = F.when(n % 7 == 3, title).when(n % 4 == 1, text("LOTE DE 7 LIBROS: bajada de precio ", letters(n))).otherwise(text("Bajada de precio en tu artículo: ", title))
    url = text(f"https://www.{M.SHOP}.net/libros/obra~x", n + 1_000_000, "?utm_source=mail")
    html = text(
        f'<html><body><table><tr><td><img src="https://img.{M.SHOP}.net/logo.gif" width="140" height="40"></td></tr><tr><td><h2>Descuento del 50%</h2></td></tr><tr><td><a href="', url,
        '"><img src="https://cloud.example/fotos/p', n, '.jpg" width="160" height="220" alt="x"></a></td><td><a href="', url, '">', title, '</a><br><span style="text-decoration:line-through">', new * 2,
        ',00 €</span> <span style="font-size:32px">', new, ',00 €</span></td></tr><tr><td bgcolor="#0a0"><a href="', url, f'">Ver</a></td></tr><tr><td><a href="https://www.{M.SHOP}.net/baja">Cancelar</a></td></tr></table></body></html>',
    )
    plain = text("Antes ", new * 2, ",00 € y ahora ", new, ",00 €\n", url)
    body = F.when(n % 7 == 3, plain).otherwise(html)
    encoded = n % 3 == 0
    head = F.when(encoded | F.contains(subject, F.lit("í")), text("=?utf-8?B?", F.base64(F.encode(subject, "UTF-8")), "?=")).otherwise(subject)
    kind = F.when(n % 7 == 3, "plain").otherwise("html")
    key = F.when(n % 5 == 0, "").otherwise(text("Message-ID: <k", n, "@x.example>\n"))
    transfer = F.when(encoded, "Content-Transfer-Encoding: base64\n").otherwise("Content-Transfer-Encoding: 8bit\n")
    raw = text("From: ", F.lit(_FROM), "\nSubject: ", head, "\nDate: ", F.lit(_DATE), "\n", key, "MIME-Version: 1.0\nContent-Type: text/", kind, "; charset=utf-8\n", transfer, "\n", F.when(encoded, F.base64(F.encode(body, "UTF-8"))).otherwise(body))
    return rows.withColumn("raw", raw)


def _subject(n: str) -> str:
    return f"CASE WHEN {n} % 7 = 3 THEN 'Obra ' || {_letters(n)} WHEN {n} % 4 = 1 THEN 'LOTE DE 7 LIBROS: bajada de precio ' || {_letters(n)} ELSE 'Bajada de precio en tu artículo: Obra ' || {_letters(n)} END"


def _key(n: str, shown: str) -> str:
    return f"CASE WHEN {n} % 5 = 0 THEN 'sha1:' || sha1('{_FROM}|' || {shown} || '|{_DATE}') ELSE 'k' || CAST({n} AS VARCHAR) || '@x.example' END"


@query(f"""SELECT p_partkey, {_key('p_partkey', 'asunto')} AS message_key, asunto, 'Obra ' || {_letters('p_partkey')} AS title,
 CAST((p_partkey % 50 + 10) * 2 AS DOUBLE) AS old_price, CAST(p_partkey % 50 + 10 AS DOUBLE) AS new_price, 50.0::DOUBLE AS discount_percent,
 'https://www.{M.SHOP}.net/libros/obra~x' || CAST(p_partkey + 1000000 AS VARCHAR) || '?utm_source=mail' AS link,
 CASE WHEN p_partkey % 7 <> 3 THEN 'https://cloud.example/fotos/p' || CAST(p_partkey AS VARCHAR) || '.jpg' END AS cover,
 CASE WHEN p_partkey % 7 = 3 THEN 0.8 ELSE 1.0 END::DOUBLE AS confidence, true AS reliable,
 CASE WHEN p_partkey % 7 <> 3 AND p_partkey % 4 = 1 THEN 7 END::INT AS libros, p_partkey % 7 <> 3 AND p_partkey % 4 = 1 AS varios
FROM (SELECT *, {_subject('p_partkey')} AS asunto FROM part)""")
def mail_fields(spark, sf):
    """Every field of a mail, read back from its bytes."""
    parsed = mails(read(spark, sf, "part").select("p_partkey"), F.col("p_partkey")).select("p_partkey", M.parse_mail(F.encode("raw", "UTF-8")).alias("m"))
    flat = parsed.select("p_partkey", "m.message_key", F.col("m.subject").alias("asunto"), "m.alert", "m.lot")
    return flat.select("p_partkey", "message_key", "asunto", *[F.col(f"alert.{c}").alias(c) for c in ("title", "old_price", "new_price", "discount_percent", "link")], F.col("alert.cover_image_url").alias("cover"), "alert.confidence", "alert.reliable", F.col("lot.book_count").cast("int").alias("libros"), (F.col("lot").isNotNull() | M.sells_several("asunto")).alias("varios"))


def _mail_folder(spark, rows: DataFrame, n: str) -> str:
    """Each mail as a file of its own, and every third a second time."""
    path = work_path(spark, "mails")
    twice = rows.select(n, "raw", F.explode(F.when(F.col(n) % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copia"))
    twice.repartition(8, n).write.partitionBy(n, "copia").text(path)
    return path


@query("""SELECT 'correos' AS que, count(*) + count(*) FILTER (WHERE s_suppkey % 3 = 0) AS n FROM supplier UNION ALL SELECT 'archivo', count(*) FROM supplier
UNION ALL SELECT 'tree', count(*) FROM supplier WHERE s_suppkey % 7 <> 3 UNION ALL SELECT 'semantic', count(*) FROM supplier WHERE s_suppkey % 7 <> 3
UNION ALL SELECT 'heuristic', count(*) FROM supplier WHERE s_suppkey % 7 = 3 UNION ALL SELECT 'pendientes', count(*) FROM supplier WHERE s_suppkey % 2 = 1""")
def mail_archive(spark, sf):
    """Mails from a folder of files, archived once each, with what found their fields; copies are there twice."""
    rows = mails(read(spark, sf, "supplier").select("s_suppkey"), F.col("s_suppkey"))
    found = X.read_mails(spark, _mail_folder(spark, rows, "s_suppkey"), "part-*")
    archive = X.archive_mails(found)
    names = rows.select(F.col("s_suppkey").cast("string").alias("name"))
    pending = X.pending_validation(names, names.where("cast(name as long) % 2 = 0"))
    count = lambda t, what: t.agg(F.count("*").alias("n")).select(F.lit(what).alias("que"), "n")
    coverage = X.strategy_coverage(found.groupBy(F.col("mail.message_key").alias("k")).agg(F.min_by("mail", "path").alias("mail")))
    return count(found, "correos").unionByName(count(archive, "archivo")).unionByName(coverage.select(F.col("category").alias("que"), F.col("mails").alias("n"))).unionByName(count(pending, "pendientes"))


def _volumes(rows: DataFrame, n: str) -> DataFrame:
    """Catalogue rows whose author and work are words of their own."""
    none = F.lit(None)
    return rows.select(F.col(n).cast("long").alias("fila"), F.col(n).cast("int").alias("orden"), F.col(n).cast("string").alias("numero"), letters(F.col(n)).alias("autor"), text("Obra ", letters(F.col(n))).alias("obras"), F.lit(0).alias("paginas"), F.lit("").alias("notas"), F.lit(False).alias("poseido"), (F.col(n) % 6 == 0).alias("deseado"), none.cast("double").alias("precio_objetivo"), none.cast("string").alias("descripcion"), none.cast("string").alias("temas"))


_STREAM = f"""WITH m AS (SELECT s_suppkey AS n, {_key('s_suppkey', _subject('s_suppkey'))} AS k, CAST(s_suppkey % 50 + 10 AS DOUBLE) AS p, {_letters('s_suppkey')} AS l, s_suppkey % 7 = 3 AS llano, s_suppkey % 7 <> 3 AND s_suppkey % 4 = 1 AS lote FROM supplier)
SELECT 'history' AS tabla, k || ' ' || CASE WHEN llano THEN 'descartado' ELSE 'notificado' END AS clave, CASE WHEN llano THEN 2 * p ELSE p END AS valor FROM m
UNION ALL SELECT 'history', k || ' lote', p FROM m WHERE lote UNION ALL SELECT 'points', 'lote::[lote ×7] obra ' || l, p FROM m WHERE lote
UNION ALL SELECT 'points', l || ' — obra ' || l, p FROM m WHERE NOT lote AND NOT llano UNION ALL SELECT 'links', CAST(n AS VARCHAR), p FROM m WHERE NOT lote AND NOT llano
UNION ALL SELECT 'lots', '[LOTE ×7] Obra ' || l, p FROM m WHERE lote UNION ALL SELECT 'notifications', k || ' price', NULL FROM m WHERE NOT llano UNION ALL SELECT 'notifications', k || ' lot', NULL FROM m WHERE lote"""


@query(_STREAM)
def mail_stream(spark, sf):
    """The file stream over a folder of mails until all is read, in several batches, then again with nothing new: the state it leaves."""
    supplier = read(spark, sf, "supplier").select("s_suppkey")
    folder, store = _mail_folder(spark, mails(supplier, F.col("s_suppkey")), "s_suppkey"), work_path(spark, "stream")
    catalogue = _volumes(supplier, "s_suppkey")
    none = spark.createDataFrame([], schemas.THRESHOLDS)
    for _ in range(2):
        W.monitor(spark, folder, f"{store}/state", f"{store}/checkpoint", lambda: catalogue, lambda: none, W.Settings(bootstrap=1 << 30, history=None), glob="part-*").awaitTermination()
    state = W.Store(spark, f"{store}/state").state()
    row = lambda t, key, value: state[t].select(F.lit(t).alias("tabla"), key.alias("clave"), value.cast("double").alias("valor"))
    parts = [
        row("history", F.concat_ws(" ", "mensaje_id", "estado"), F.col("precio_new")), row("points", F.col("clave"), F.col("precio")), row("links", F.col("numero"), F.col("ultimo_precio")),
        row("lots", F.col("titulo"), F.col("ultimo_precio")), row("notifications", F.concat_ws(" ", "mensaje_id", "kind"), F.lit(None)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(f"""SELECT mensaje_id, tipo FROM (SELECT {_key('s_suppkey', _subject('s_suppkey'))} AS mensaje_id, s_suppkey, s_suppkey % 7 <> 3 AS html, s_suppkey % 4 = 1 AS lote FROM supplier), (VALUES ('price'), ('lot')) t(tipo)
WHERE html AND (tipo = 'price' OR lote)""")
def mail_replay(spark, sf):
    """A batch decided twice: known mails are analysed again and not notified, unless a replay is asked for."""
    rows = mails(read(spark, sf, "supplier").select("s_suppkey"), F.col("s_suppkey"))
    folder = work_path(spark, "replay")
    rows.select(M.parse_mail(F.encode("raw", "UTF-8")).alias("mail"), F.col("s_suppkey").alias("seq"), F.lit("2026-08-07 10:00:00").cast("timestamp_ntz").alias("now")).write.parquet(f"{folder}/mails")
    parsed = spark.read.parquet(f"{folder}/mails")
    catalogue, none = _volumes(read(spark, sf, "supplier"), "s_suppkey"), spark.createDataFrame([], schemas.THRESHOLDS)
    empty = {t: spark.createDataFrame([], s) for t, s in W.TABLES.items()}
    store = W.Store(spark, f"{folder}/state")
    store.put(W.apply(empty, W.decide(parsed, empty, catalogue, none, W.Settings())), 0)
    first = store.state()
    known = W.decide(parsed, first, catalogue, none, W.Settings())["notifications"]
    again = W.decide(parsed.withColumn("replay", F.lit(True)), first, catalogue, none, W.Settings())["notifications"]
    return again.unionByName(known).select("mensaje_id", F.col("kind").alias("tipo"))


_WAVES = """WITH o AS (SELECT 's' || CAST(o_custkey AS VARCHAR) AS clave, o_orderkey AS k, CAST(o_totalprice AS DOUBLE) AS precio FROM orders),
x AS (SELECT *, (k % 3) * 1000000000 + k AS seq, 'new' AS estado FROM o UNION ALL SELECT *, 1500000000 + k, 'again' FROM o WHERE k % 30 = 3 UNION ALL SELECT *, 2500000000 + k, 'replayed' FROM o WHERE k % 30 = 0),
y AS (SELECT *, last_value(CASE WHEN estado = 'new' THEN precio END IGNORE NULLS) OVER (PARTITION BY clave ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anterior FROM x)
SELECT clave, precio, 'm' || CAST(k AS VARCHAR) AS mensaje_id, CAST(seq AS BIGINT) AS seq, estado, anterior, coalesce(precio > anterior, false) AS risen FROM y"""


@query(_WAVES)
def price_stream(spark, sf):
    """The keyed stream of prices, started three times on one checkpoint: orders come in three waves, some of the first again in the second, and some are asked for
    again in the third."""
    k = F.col("o_orderkey").cast("long")
    rows = read(spark, sf, "orders").select(text("s", F.col("o_custkey")).alias("clave"), F.lit("t").alias("titulo"), F.col("o_totalprice").cast("double").alias("precio"), text("m", k).alias("mensaje_id"), k.alias("k"))
    folder = work_path(spark, "prices")
    for wave in range(3):
        own = rows.where(F.col("k") % 3 == wave).withColumns({"seq": F.col("k") + wave * 1_000_000_000, "replay": F.lit(False)})
        if wave:
            first, at = rows.where(F.col("k") % 30 == (3 if wave == 1 else 0)), wave * 1_000_000_000 + 500_000_000
            own = own.unionByName(first.withColumns({"seq": F.col("k") + at, "replay": F.lit(wave == 2)}))
        own.drop("k").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(P.POINT).parquet(f"{folder}/in")
        P.start(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(P.OUT).parquet(f"{folder}/out").drop("titulo")


@query("""WITH f AS (SELECT s_suppkey AS n, s_suppkey % 8 <> 0 AS bueno FROM supplier), b AS (SELECT n FROM f ORDER BY n DESC LIMIT 40)
SELECT 'arranque' AS que, CAST(n AS VARCHAR) AS ruta FROM b UNION ALL SELECT 'fallo', CAST(n AS VARCHAR) FROM f WHERE NOT bueno""")
def mail_bootstrap(spark, sf):
    """The first batch takes the newest forty mails; mails that can't be read go to the table of failures."""
    rows = spread(read(spark, sf, "supplier").select("s_suppkey")).select(F.col("s_suppkey").cast("string").alias("path"), F.timestamp_seconds(F.col("s_suppkey") + 1_000_000).alias("modificationTime"), "s_suppkey")
    first = W.newest(rows, W.Settings().bootstrap)
    good = mails(rows, F.col("s_suppkey")).select("path", "s_suppkey", M.parse_mail(F.encode("raw", "UTF-8")).alias("mail"))
    error = F.when(F.col("s_suppkey") % 8 == 0, "ValueError: broken")
    broken = good.withColumn("mail", F.col("mail").withField("error", error)).select("path", "mail", F.col("s_suppkey").alias("seq"), F.lit("2026-08-07 10:00:00").cast("timestamp_ntz").alias("now"))
    # Mails are read once, not again by each step of the batch.
    folder = work_path(spark, "bootstrap")
    broken.write.parquet(folder)
    broken = spark.read.parquet(folder)
    empty = {t: spark.createDataFrame([], s) for t, s in W.TABLES.items()}
    new = W.decide(broken, empty, _volumes(rows, "s_suppkey"), spark.createDataFrame([], schemas.THRESHOLDS), W.Settings())
    return first.select(F.lit("arranque").alias("que"), F.col("path").alias("ruta")).unionByName(new["failures"].select(F.lit("fallo").alias("que"), F.col("path").alias("ruta")))


# --- listings and watch lists -------------------------------------------------------------------------------------------


def _listing_page() -> Column:
    n = F.col("p_partkey")
    price = text(n % 90 + 5, ",50")
    return (
        F.when(n % 7 == 0, text('<meta itemprop="price" content="', price, '"><p>99,00 €</p>'))
        .when(n % 7 == 1, text('<meta property="product:price:amount" content="', n % 90 + 5, '.50">'))
        .when(n % 7 == 2, text('<script>{"price": {"amount": "', n % 90 + 5, '.50", "c": 1}}</script>'))
        .when(n % 7 == 3, text('<script>{"price": "', n % 90 + 5, '.50"}</script>'))
        .when(n % 7 == 4, text("<b data-price='", price, "'>x</b>"))
        .when(n % 7 == 5, text("<p>envío 0,10 € y cuesta ", price, " €</p>"))
        .otherwise("<p>sin precio</p>")
    )


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 <> 6 THEN CAST(p_partkey % 90 AS DOUBLE) + 5.5 END AS precio FROM part")
def listing_prices(spark, sf):
    """The price of a page from each place that may state it, in the order of trust."""
    rows = read(spark, sf, "part").withColumn("html", _listing_page()).select("p_partkey", "html", M.html_text(F.col("html")).alias("t"))
    return rows.select("p_partkey", T.listing_price(F.col("html"), F.col("t.text")).alias("precio"))


@query("""SELECT p_partkey, 'Título ' || p_name || chr(10) || p_type || ' & más' AS texto, 'https://x.example/' || CAST(p_partkey AS VARCHAR) AS enlace FROM part""")
def html_words(spark, sf):
    """Visible text and links of a page."""
    page = text("<html><head><style>p{}</style><script>var x='no';</script></head><body><h1>Título ", F.col("p_name"), "</h1><p>", F.col("p_type"), ' &amp; más</p><a href="https://x.example/', F.col("p_partkey"), '"></a></body></html>')
    rows = read(spark, sf, "part").select("p_partkey", M.html_text(page).alias("t"))
    lines = F.filter(F.transform(F.split("t.text", "\n"), T.strip), lambda x: x != "")
    return rows.select("p_partkey", F.array_join(lines, "\n").alias("texto"), F.col("t.links")[0].alias("enlace"))


@query("""WITH w AS (SELECT s_suppkey AS n FROM supplier)
SELECT 'enlace' AS tabla, CAST(n AS VARCHAR) AS clave, CASE n % 3 WHEN 0 THEN NULL WHEN 1 THEN n + 5.5 ELSE n + 1.0 END::DOUBLE AS precio FROM w
UNION ALL SELECT 'punto', 's' || CAST(n AS VARCHAR), CASE WHEN n % 2 = 0 THEN n + 5.5 ELSE n + 1.0 END FROM w WHERE n % 3 <> 0
UNION ALL SELECT 'punto', 's' || CAST(n AS VARCHAR), n + 5.5 FROM w WHERE n % 3 = 1 AND n % 2 = 1""")
def listing_refresh(spark, sf):
    """Watched listings looked at again: sold ones lose price and points, others append a point where the price moved."""
    n = F.col("s_suppkey")
    rows = read(spark, sf, "supplier")
    key, url = text("s", n), text("https://x.example/lote/", n)
    watch = rows.select(n.cast("string").alias("numero"), key.alias("clave"), text(url, "?c=1").alias("url"), (n + 1.0).alias("ultimo_precio"), F.lit(False).alias("vendido"))
    html = F.when(n % 3 == 0, '"availability":"https://schema.org/SoldOut"').when(n % 3 == 1, text("<p>", n + 5, ",50 €</p>")).otherwise("<p>nada</p>")
    points = rows.select(n.alias("id"), key.alias("clave"), key.alias("titulo"), F.lit("2026-01-01").cast("timestamp_ntz").alias("fecha"), F.when(n % 2 == 0, n + 5.5).otherwise(n + 1.0).alias("precio"), url.alias("url"), F.lit(None).cast("string").alias("mensaje_id"))
    new, left = W.refresh_series(watch, rows.select(text(url, "/").alias("url"), html.alias("html")), points)
    return new.select(F.lit("enlace").alias("tabla"), F.col("numero").alias("clave"), F.col("ultimo_precio").alias("precio")).unionByName(left.select(F.lit("punto").alias("tabla"), "clave", "precio"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal WHEN c_custkey % 2 = 0 THEN 1.5 END AS ultimo_precio,
 CASE WHEN c_custkey % 3 = 0 THEN '2026-02-02' ELSE '2026-01-01' END AS ultima_revision FROM customer WHERE c_custkey % 10 <> 0""")
def watch_crud(spark, sf):
    """A watch list after prices were taken, some of them gone, and rows removed."""
    rows = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("ultimo_precio"), F.lit("2026-01-01").alias("ultima_revision"))
    seen = rows.where("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, 1.5).alias("precio"), F.lit("2026-02-02").alias("fecha"))
    return S.remove_watched(S.update_watched(rows, seen), rows.where("id % 10 = 0"))


@query("SELECT c_custkey AS id FROM customer WHERE c_nationkey = (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 3)")
def watched_of(spark, sf):
    """The links of a volume that is asked for by its order, which no volume has as its number."""
    volumes = read(spark, sf, "nation").select(F.col("n_nationkey").alias("fila"), text("n", F.col("n_nationkey")).alias("numero"), F.col("n_regionkey").alias("orden"))
    links = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), text("n", F.col("c_nationkey")).alias("numero"))
    return S.watched_of(links, volumes, "3").select("id")


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 3 = 0")
def known_rows(spark, sf):
    """Existence alone: the orders of known customers."""
    done = read(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey")).unionByName(spark.range(0, 30_000_000, 3, 8).select(F.col("id").alias("o_custkey")).where("id < 3000000"))
    return S.known(done, read(spark, sf, "orders"), ["o_custkey"]).select("o_orderkey")


@query("""SELECT s_suppkey AS fila, CASE WHEN s_suppkey % 2 = 0 THEN 'd' || CAST(s_suppkey AS VARCHAR) ELSE 'x' END AS descripcion, CASE WHEN s_suppkey % 4 = 0 THEN 9.5 END::DOUBLE AS precio_objetivo FROM supplier""")
def set_fields(spark, sf):
    """Single fields of catalogue rows, by number; null leaves a field as it is."""
    rows = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("fila"), F.col("s_suppkey").cast("int").alias("orden"), F.col("s_suppkey").cast("string").alias("numero"), F.lit("x").alias("descripcion"), F.lit(None).cast("double").alias("precio_objetivo"))
    changes = rows.where("fila % 2 = 0").select(F.col("numero").alias("key"), text("d", F.col("fila")).alias("descripcion"), F.when(F.col("fila") % 4 == 0, 9.5).alias("precio_objetivo"))
    return S.set_fields(rows, changes).select("fila", "descripcion", "precio_objetivo")


@query(f"""WITH s AS (SELECT CAST(o_custkey % 300 AS VARCHAR) AS clave, max(o_orderkey) AS last_id, arg_max(o_totalprice, o_orderkey) AS u FROM orders GROUP BY 1), p AS (SELECT *, CASE WHEN last_id % 5 <> 0 THEN u END AS ultimo FROM s)
SELECT 'dearest' AS modo, clave FROM (SELECT * FROM p ORDER BY coalesce(ultimo, -1) DESC, last_id DESC LIMIT 20) UNION ALL SELECT 'cheapest', clave FROM (SELECT * FROM p ORDER BY coalesce(ultimo, -1), last_id DESC LIMIT 20)
UNION ALL SELECT 'stored', clave FROM (SELECT * FROM p ORDER BY last_id DESC LIMIT 20)
UNION ALL SELECT 'least discount', CAST(id AS VARCHAR) FROM (SELECT id FROM {HISTORY} ORDER BY descuento ASC NULLS LAST, id DESC LIMIT 20)
UNION ALL SELECT 'price high', CAST(id AS VARCHAR) FROM (SELECT id FROM {HISTORY} ORDER BY precio_new DESC NULLS LAST, id DESC LIMIT 20)
UNION ALL SELECT 'owned', CAST(s_suppkey AS VARCHAR) FROM (SELECT * FROM supplier ORDER BY s_suppkey % 3 = 0 DESC, s_nationkey, s_suppkey LIMIT 20)
UNION ALL SELECT 'wished', CAST(s_suppkey AS VARCHAR) FROM (SELECT * FROM supplier ORDER BY s_suppkey % 4 = 0 DESC, s_nationkey, s_suppkey LIMIT 20)""")
def list_orders(spark, sf):
    """The first of each order of series, alerts and the collection; a series without a price counts as -1."""
    own = read(spark, sf, "orders").groupBy((F.col("o_custkey") % 300).cast("string").alias("clave")).agg(F.max("o_orderkey").alias("last_id"), F.max_by("o_totalprice", "o_orderkey").alias("u")).withColumn("ultimo", F.when(F.col("last_id") % 5 != 0, F.col("u")))
    top = lambda rows, order, mode, key: rows.orderBy(*order).limit(20).select(F.lit(mode).alias("modo"), F.col(key).cast("string").alias("clave"))
    alerts = history(spark, sf)
    volumes = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("fila"), F.col("s_nationkey").alias("orden"), (F.col("s_suppkey") % 3 == 0).alias("poseido"), (F.col("s_suppkey") % 4 == 0).alias("deseado"))
    parts = [top(own, S.price_order(m), m, "clave") for m in ("dearest", "cheapest", "stored")]
    parts += [top(alerts, S.history_order("least discount"), "least discount", "id"), top(alerts, S.history_order("dearest"), "price high", "id")]
    parts += [top(volumes, S.collection_order(m), m, "fila") for m in ("owned", "wished")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(f"""SELECT '21:30' AS hora, CAST(fecha AS DATE) AS dia, count(*) FILTER (WHERE estado = 'notificado') AS notificados, count(*) FILTER (WHERE estado = 'lote') AS lotes FROM {HISTORY}
WHERE CAST(fecha AS DATE) = (SELECT CAST(min(o_orderdate) AS DATE) FROM orders) GROUP BY 2""")
def daily_summary(spark, sf):
    """The summary of a day: not before its hour, once, and not for a day without alerts."""
    rows, meta = history(spark, sf), spark.createDataFrame([], schemas.META)
    day = str(rows.agg(F.min(F.to_date("fecha"))).collect()[0][0])
    out = None
    for date, clock in ((day, "20:59"), (day, "21:30"), (day, "22:00"), ("1900-01-01", "23:00")):
        sent, meta = S.daily_summary(rows, meta, date, clock)
        part = sent.select(F.lit(clock).alias("hora"), "dia", "notificados", "lotes")
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT 'poseidos' AS vista, CAST(s_suppkey AS VARCHAR) AS clave FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT 'deseados', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 5 = 0
UNION ALL SELECT 'faltan', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT 'raros', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey * 10 BETWEEN 360 AND 415
UNION ALL SELECT 'sin descripcion', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT 'busca', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE contains(lower(s_name), '00007')
UNION ALL SELECT 'cuentas', concat_ws(' ', count(*), count(*) FILTER (WHERE s_suppkey % 3 = 0), count(*) FILTER (WHERE s_suppkey % 5 = 0), count(*) FILTER (WHERE s_suppkey % 4 <> 0)) FROM supplier
UNION ALL SELECT 'indice', concat_ws(' ', count(*), sum(s_suppkey), sum(s_suppkey * 2), sum(s_suppkey % 7)) FROM supplier""")
def collection_views(spark, sf):
    """The collection by what is owned, wished, missing, rare, undescribed or looked for, and its counts."""
    n = F.col("s_suppkey")
    rows = read(spark, sf, "supplier").select(n.alias("fila"), (n * 10).cast("int").alias("orden"), F.col("s_name").alias("autor"), (n % 3 == 0).alias("poseido"), (n % 5 == 0).alias("deseado"), F.when(n % 4 == 0, " ").otherwise("d").alias("descripcion"), n.alias("pasajes"), (n * 2).alias("palabras"), (n % 7).alias("nombres"))
    shown = lambda t, what: t.select(F.lit(what).alias("vista"), F.col("fila").cast("string").alias("clave"))
    parts = [shown(V.collection_view(rows, view), name) for view, name in (("owned", "poseidos"), ("wished", "deseados"), ("missing", "faltan"), ("rare", "raros"))]
    parts += [shown(V.without_description(rows), "sin descripcion"), shown(rows.where(V.matches([F.col("autor")], "00007")), "busca")]
    parts += [t.select(F.lit(what).alias("vista"), F.concat_ws(" ", *[F.col(c).cast("string") for c in t.columns]).alias("clave")) for t, what in ((V.catalogue_counts(rows), "cuentas"), (V.index_summary(rows), "indice"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("SELECT count(*) AS correos, count(*) FILTER (WHERE s_suppkey % 7 = 3) AS dudosos, 0::BIGINT AS errores, round(avg(CASE WHEN s_suppkey % 7 = 3 THEN 0.8 ELSE 1.0 END::DOUBLE), 4) AS confianza FROM supplier")
def parsing_report(spark, sf):
    rows = mails(read(spark, sf, "supplier").select("s_suppkey"), F.col("s_suppkey")).select(M.parse_mail(F.encode("raw", "UTF-8")).alias("mail"))
    return V.parsing_report(rows, 0.9)


# --- resolution ---------------------------------------------------------------------------------------------------------


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE c_custkey % (SELECT count(*) FROM supplier) END AS fila FROM customer""")
def resolve_titles(spark, sf):
    """Titles that name a volume by author and work, or by its number in the series, or none."""
    supplier = read(spark, sf, "supplier")
    volumes, n = _volumes(supplier, "s_suppkey"), F.col("c_custkey") % supplier.count()
    title = F.when(F.col("c_custkey") % 3 == 0, text("Libro antiguo. ", letters(n), ", OBRA ", letters(n), " (1983)")).when(F.col("c_custkey") % 3 == 1, text("Tomo suelto, Gredos nº ", n)).otherwise("Nada que ver, 1983")
    # Numbers of the series have three digits at most.
    volumes = volumes.withColumn("orden", F.when(F.col("fila") < 1000, F.col("orden")))
    titles = read(spark, sf, "customer").select("c_custkey", F.when((F.col("c_custkey") % 3 == 1) & (n >= 1000), text("Libro. ", letters(n), ", OBRA ", letters(n))).otherwise(title).alias("titulo"))
    return R.resolve(titles, volumes, most=70).select("c_custkey", "fila")


@query(f"""SELECT c_custkey, unnest([c_custkey % (SELECT count(*) FROM supplier), (c_custkey + 1) % (SELECT count(*) FROM supplier)]) AS fila FROM customer WHERE (SELECT count(*) FROM supplier) > 1""")
def resolve_listings(spark, sf):
    """Every volume that a listing's text names, once each."""
    supplier = read(spark, sf, "supplier")
    count = supplier.count()
    one = lambda n: text(letters(n), ". Obra ", letters(n), " | envío gratis; ")
    a, b = F.col("c_custkey") % count, (F.col("c_custkey") + 1) % count
    rows = read(spark, sf, "customer").select("c_custkey", text(one(a), "\n", one(b), one(a)).alias("texto"))
    return R.resolve_many(rows, _volumes(supplier, "s_suppkey"), "c_custkey", "texto").select("c_custkey", "fila")


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND (SELECT count(*) FROM supplier) > 1 THEN '[LOTE ×2] ' || l1 || ' — Obra ' || l1 || ' + ' || l2 || ' — Obra ' || l2 ELSE 'Lote viejo' END AS titulo
FROM (SELECT c_custkey, {_letters('least(a, b)')} AS l1, {_letters('greatest(a, b)')} AS l2 FROM (SELECT c_custkey, c_custkey % (SELECT count(*) FROM supplier) AS a, (c_custkey + 1) % (SELECT count(*) FROM supplier) AS b FROM customer))""")
def new_lots(spark, sf):
    """Titles of lots by hand: the volumes that the listing names in the order of the series, else what its address says."""
    supplier = read(spark, sf, "supplier")
    count = supplier.count()
    a, b = F.col("c_custkey") % count, (F.col("c_custkey") + 1) % count
    one = lambda n: text(letters(n), ". Obra ", letters(n))
    named = F.when(F.col("c_custkey") % 2 == 0, text(one(b), "\n", one(a))).otherwise("nada que ver aquí")
    rows = read(spark, sf, "customer").select("c_custkey", text("https://x.example/a", F.col("c_custkey"), "/lote-viejo~x123456").alias("url"), named.alias("texto"))
    return V.new_lots(rows, _volumes(supplier, "s_suppkey")).join(rows.select("url", "c_custkey"), "url").select("c_custkey", "titulo")


@query("SELECT s_suppkey AS fila FROM supplier WHERE s_suppkey IN (3, 5)")
def lot_preselection(spark, sf):
    volumes = _volumes(read(spark, sf, "supplier"), "s_suppkey")
    word = lambda n: "q" + str(n).rjust(9, "0").translate(str.maketrans("0123456789", "bcdfghjklm")) + "z"
    return V.preselected(f"[LOTE ×2] {word(3)} — Obra {word(3)} + {word(5).upper()} —  Obra {word(5)}", volumes).select("fila")


@query("""SELECT p_partkey, p_partkey % 3 <> 0 AS colectivo, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN 'Focílides' ELSE '' END AS autor,
 'https://s.example/?q=' || replace(url_encode(trim(concat_ws(' ', CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN 'Focílides' END, p_name))), '%20', '+') AS url FROM part""")
def search_links(spark, sf):
    author = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).when(F.col("p_partkey") % 3 == 1, "VV. AA. (Focílides)").otherwise("Anónimo")
    rows = read(spark, sf, "part")
    return rows.select("p_partkey", R.collective_author(author).alias("colectivo"), R.author_for_search(author).alias("autor"), R.search_url("https://s.example/?q=", author, F.col("p_name")).alias("url"))


@query("""SELECT s_suppkey, 'Tomo nº ' || CAST(s_suppkey * 10 AS VARCHAR) || ' — ' || s_name || CASE WHEN s_suppkey % 3 <> 0 THEN ' · ' || CAST(s_suppkey % 3 * 100 AS VARCHAR) || ' págs.' ELSE '' END ||
 CASE WHEN s_suppkey % 4 = 0 THEN ' · ya obtenido ✔' WHEN s_suppkey % 5 = 0 THEN ' · ⭐ DESEADO' ELSE ' · ¡TE FALTA!' END || CASE WHEN s_suppkey * 10 BETWEEN 360 AND 415 THEN ' · 💎 RARO (360-415)' WHEN s_suppkey * 10 BETWEEN 416 AND 420 THEN ' · apéndice (fuera de colección)' ELSE '' END ||
 CASE WHEN s_suppkey % 2 = 0 THEN ' · precio objetivo alcanzado' ELSE '' END AS linea FROM supplier""")
def volume_lines(spark, sf):
    n = F.col("s_suppkey")
    rows = read(spark, sf, "supplier").select("s_suppkey", (n * 10).cast("int").alias("orden"), n.cast("string").alias("numero"), F.col("s_name").alias("autor"), (n % 3 * 100).cast("int").alias("paginas"), (n % 4 == 0).alias("poseido"), (n % 5 == 0).alias("deseado"))
    return rows.select("s_suppkey", R.volume_extra(F.col("s_suppkey") % 2 == 0).alias("linea"))


# --- files --------------------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, CAST(p_size AS VARCHAR) AS numero, p_size AS orden, p_brand AS autor, CASE WHEN p_partkey % 4 <> 0 THEN p_name ELSE '' END AS obras, CASE WHEN p_partkey % 2 = 0 THEN p_size * 10 END AS paginas FROM part""")
def catalogue_csv(spark, sf):
    """A catalogue written as CSV and read back: numbers without the tail of a numeric cell, rows without author and work left out."""
    path = work_path(spark, "catalogue")
    n = F.col("p_partkey")
    good = read(spark, sf, "part").select(text(F.col("p_size"), ".0").alias("numero"), text("  ", F.col("p_brand"), " ").alias("autor"), F.when(n % 4 != 0, F.col("p_name")).otherwise("").alias("obras"), F.when(n % 2 == 0, text(F.col("p_size") * 10, " págs.")).otherwise("s. n.").alias("paginas"), text("k", n).alias("notas"))
    empty = good.where("notas like '%7'").select("numero", F.lit(" ").alias("autor"), F.lit("").alias("obras"), "paginas", "notas")
    good.unionByName(empty).write.csv(path, header=True)
    return X.read_catalogue(spark, path).select(F.substring("notas", 2, 20).cast("long").alias("p_partkey"), "numero", "orden", "autor", "obras", "paginas")


def _volume_files(spark, sf, path: str, changed: bool = False) -> None:
    """The documents of a source as a volume of JSON lines; changed: another text for the first source alone."""
    docs = read(spark, sf, "documents").where("doc_id is not null")
    if changed:
        docs = docs.where("source = 'src0'").withColumn("text", F.lit("otro texto"))
    place = F.substring("canonico", 4, 9).cast("int")
    headers = docs.select(F.col("source").alias("canonico")).distinct().select(F.lit("tomo").alias("tipo"), "canonico", place.alias("orden"), place.cast("string").alias("numero"), text("Autor: ", F.col("canonico")).alias("autor"), F.lit("Obras/varias").alias("obras"), F.lit("native").alias("estado"), F.lit("impreso").alias("formato"), F.lit(7).alias("hojas_texto"), F.create_map(F.lit("Aquiles"), F.array(F.lit("1"), F.lit("2")), F.lit("ibid"), F.array(F.lit("3")), F.col("canonico"), F.array(F.lit("4"))).alias("indice_nombres"))
    pages = docs.select(F.col("source").alias("canonico"), F.lit("pagina").alias("tipo"), F.col("doc_id").cast("int").alias("pdf"), F.lit("texto").alias("seccion"), F.lit("").alias("titulo"), F.lit("").alias("obra"), F.col("text").alias("cuerpo"), F.lit("").alias("notas"))
    X.write_volumes(headers, pages, path, keep_others=changed)


@query("""SELECT source AS canonico, lpad(source[4:], 3, '0') || ' - Autor- ' || source || ' - Obras-varias.jsonl' AS archivo, CAST(doc_id AS INT) AS pdf, md5(text) AS cuerpo FROM documents WHERE doc_id IS NOT NULL""")
def volume_files(spark, sf):
    """Volumes written as JSON lines, a file each, and read back."""
    path = work_path(spark, "volumes")
    _volume_files(spark, sf, path)
    _, pages, _ = X.read_volumes(spark, path)
    name = F.try_url_decode(F.replace(F.regexp_extract("archivo", "archivo=([^/]*)/", 1), F.lit("+"), F.lit("%2B")))
    return pages.select("canonico", F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("archivo"), "pdf", F.md5(F.col("cuerpo").cast("binary")).alias("cuerpo"))


@query("""WITH s AS (SELECT DISTINCT source AS canonico FROM documents WHERE doc_id IS NOT NULL) SELECT 'estado' AS que, canonico FROM s UNION ALL SELECT 'por leer', 'src0' UNION ALL SELECT 'por quitar', 'src0' UNION ALL SELECT 'de cache', canonico FROM s""")
def volume_states(spark, sf):
    """Headers alone, from the files or from the table of an earlier look; files that changed against a manifest."""
    path = work_path(spark, "volumes")
    _volume_files(spark, sf, path)
    kept = work_path(spark, "states")
    X.volume_states(spark, path).write.parquet(kept)
    first = spark.read.parquet(kept)
    _volume_files(spark, sf, path, changed=True)
    files = X.read_volumes(spark, path)[0].select("archivo", "mtime", "bytes", "canonico")
    to_read, to_drop = X.changed_files(files, first)
    second = X.volume_states(spark, path, first)
    shown = lambda t, what: t.select(F.lit(what).alias("que"), "canonico")
    return shown(first, "estado").unionByName(shown(to_read, "por leer")).unionByName(shown(to_drop, "por quitar")).unionByName(shown(second, "de cache"))


_ALL_WORK = CHUNKS.replace("[CAST(doc_id % 8 AS INT) + 1] AS s", "[1] AS s")


@query(f"""WITH {_ALL_WORK}, v AS (SELECT canonico, count(*) AS p FROM chunks GROUP BY canonico), d AS (SELECT count(*) AS n, count(*) FILTER (WHERE source = 'src0') AS n0 FROM documents WHERE doc_id IS NOT NULL), s AS (SELECT count(DISTINCT source) AS t FROM documents WHERE doc_id IS NOT NULL)
SELECT 'primera' AS que, t AS tomos, t AS total, (SELECT sum(p) FROM v)::BIGINT AS pasajes, 2 * t AS nombres, 0::BIGINT AS saltados, 0::BIGINT AS borrados FROM s
UNION ALL SELECT 'segunda', 1, t - 1, (SELECT n0 FROM d), 2, t - 2, 1 FROM s UNION ALL SELECT 'tercera', 0, t - 1, 0, 0, t - 1, 0 FROM s
UNION ALL SELECT 'tabla', t - 1, t - 1, (SELECT sum(p) FROM v WHERE canonico NOT IN ('src0', 'src1'))::BIGINT + (SELECT n0 FROM d), 2 * (t - 1), 0, 0 FROM s""")
def index_update(spark, sf):
    """An index after a first run, after one volume changed and one is gone, and after nothing; then what its tables hold."""
    path, store = work_path(spark, "volumes"), IndexStore(spark, work_path(spark, "index"))
    _volume_files(spark, sf, path)
    runs = [store.update(path)]
    _volume_files(spark, sf, path, changed=True)
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    root = jvm(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(root):
        if status.getPath().getName().startswith("archivo=001 - "):
            fs.delete(status.getPath(), True)
    runs += [store.update(path), store.update(path)]
    store.compact()
    rows = [(name, r.tomos, r.total, r.pasajes, r.nombres, r.saltados, r.borrados) for name, r in zip(("primera", "segunda", "tercera"), runs, strict=True)]
    volumes, index = store.volumes().count(), store.index()
    rows.append(("tabla", volumes, index.passages and volumes, store.table("pasajes").select("id").distinct().count(), store.table("nombres").count(), 0, 0))
    return spark.createDataFrame(rows, "que string, tomos long, total long, pasajes long, nombres long, saltados long, borrados long")


@query("""SELECT nombre, normal, refs, cuantas, canonico, autor, orden FROM (SELECT DISTINCT source AS canonico, 'Autor: ' || source AS autor, CAST(source[4:] AS INT) AS orden FROM documents WHERE doc_id IS NOT NULL),
 LATERAL (SELECT 'Aquiles' AS nombre, 'aquiles' AS normal, '1; 2' AS refs, 2::INT AS cuantas UNION ALL SELECT canonico, canonico, '4', 1::INT)""")
def volume_names_joined(spark, sf):
    """Names of all volumes with author and place of their volume, entries that are no names left out."""
    path, store = work_path(spark, "volumes"), IndexStore(spark, work_path(spark, "index"))
    _volume_files(spark, sf, path)
    store.update(path)
    return joined_names(store.table("nombres").drop("archivo", "generacion"), store.volumes()).select("nombre", "normal", "refs", "cuantas", "canonico", "autor", "orden")


@query("""SELECT 'coleccion' AS modo, canonico FROM (SELECT DISTINCT source AS canonico FROM documents WHERE doc_id IS NOT NULL ORDER BY CAST(canonico[4:] AS INT), canonico LIMIT 7)
UNION ALL SELECT 'alfabeto', n FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN replace(n_name, 'A', 'Á') ELSE n_name END AS n FROM nation ORDER BY lower(n_name), n LIMIT 7)""")
def volume_orders(spark, sf):
    """Volumes in the order of the collection, and by their titles without accents."""
    path, store = work_path(spark, "volumes"), IndexStore(spark, work_path(spark, "index"))
    _volume_files(spark, sf, path)
    store.update(path)
    names = read(spark, sf, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, F.replace("n_name", F.lit("A"), F.lit("Á"))).otherwise(F.col("n_name")).alias("canonico"))
    return store.volumes().limit(7).select(F.lit("coleccion").alias("modo"), "canonico").unionByName(alphabetical(names).limit(7).select(F.lit("alfabeto").alias("modo"), "canonico"))


@query("""SELECT 'archivo' AS que, CASE WHEN s_suppkey % 10 = 0 THEN 'keep_' ELSE 'm' END || CAST(s_suppkey AS VARCHAR) AS name FROM supplier WHERE s_suppkey % 10 = 0 OR (SELECT count(*) FROM supplier WHERE s_suppkey % 10 <> 0) <= 50
 OR s_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 <> 0 ORDER BY s_suppkey LIMIT 20)
UNION ALL SELECT 'esperado', 'keep_' || CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 10 = 0
UNION ALL SELECT 'cuenta', CAST(3 + count(*) AS VARCHAR) || ' 2026-08-09' FROM supplier WHERE s_suppkey % 10 = 0""")
def archive_rotation(spark, sf):
    """An archive without its oldest mails, expectations without a mail removed with them, confirmations counted."""
    n = F.col("s_suppkey")
    rows = read(spark, sf, "supplier").select(text(F.when(n % 10 == 0, "keep_").otherwise("m"), n).alias("name"), n.alias("received"))
    left = X.rotate_archive(rows)
    batch = rows.where("name like 'keep_%'").select("name", F.lit("{}").alias("expected"), F.lit("2026-08-09").alias("at"))
    stats = spark.createDataFrame([(3, "2026-08-01", 0)], "validated long, last_training string, rotated_out long")
    none = spark.createDataFrame([("gone", "{}")], "name string, expected string")
    expected, counted = X.mark_validated(none, stats, batch)
    return left.select(F.lit("archivo").alias("que"), "name").unionByName(X.rotate_expectations(left, expected).select(F.lit("esperado").alias("que"), "name")).unionByName(counted.select(F.lit("cuenta").alias("que"), F.concat_ws(" ", F.col("validated").cast("string"), "last_training").alias("name")))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 AND doc_id % 8 = 0 THEN repeat('t', 40) WHEN doc_id % 4 = 0 THEN '' ELSE 'propio' END AS cuerpo, doc_id % 8 = 0 AS ocr FROM documents WHERE doc_id IS NOT NULL""")
def recognised_text(spark, sf):
    """Recognised text where a sheet had none, if there is enough of it."""
    pages = read(spark, sf, "documents").where("doc_id is not null").select(F.col("source").alias("canonico"), F.col("doc_id").alias("pdf"), F.when(F.col("doc_id") % 4 == 0, "").otherwise("propio").alias("cuerpo"), F.lit(False).alias("ocr"))
    found = pages.select("canonico", "pdf", F.when(F.col("pdf") % 8 == 0, F.repeat(F.lit("t"), F.lit(40))).otherwise("corto").alias("texto"))
    return X.merge_recognised(pages, found, 40).select(F.col("pdf").alias("doc_id"), "cuerpo", "ocr")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN repeat('r', 45) END AS resumen, CASE WHEN p_partkey % 3 <> 0 THEN lower(p_brand) || ',' || lower(p_type) END AS temas, CASE WHEN p_partkey % 3 <> 0 THEN least(1.0, p_partkey % 3 * 0.75) END::DOUBLE AS confianza,
 'Describe este volumen de la Biblioteca Clásica Gredos.' || chr(10) || chr(10) || 'Autor: ' || CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '(sin autor: obra colectiva o anónima)' END || chr(10) || 'Obra(s) según la colección: ' || p_name ||
 CASE WHEN p_partkey % 5 <> 0 THEN chr(10) || 'Páginas: ' || CAST(p_partkey % 5 AS VARCHAR) ELSE '' END || chr(10) || 'Número en la Biblioteca Clásica Gredos: ' || CAST(p_size AS VARCHAR) || chr(10) || chr(10) || 'Responde EXACTAMENTE con este JSON:' || chr(10) || '{{}}' AS pregunta FROM part""".replace("{{}}", "{}"))
def descriptions(spark, sf):
    """What a language model is asked, and its answers checked."""
    n = F.col("p_partkey")
    answer = text('Claro: {"resumen": "', F.when(n % 3 == 0, "corto").otherwise("r" * 45), '", "temas": ["', F.col("p_brand"), '", " ', F.lower("p_brand"), '", "", "', F.col("p_type"), '"], "confianza": ', n % 3 * 0.75, "} fin")
    rows = read(spark, sf, "part").withColumns({"a": X.description(answer), "autor": F.when(n % 2 == 0, F.col("p_brand")).otherwise(""), "obras": F.col("p_name"), "sufijo": F.lit(""), "notas": F.lit(None).cast("string"), "paginas": n % 5, "orden": F.col("p_size")})
    return rows.select("p_partkey", "a.resumen", F.array_join("a.temas", ",").alias("temas"), "a.confianza", X.prompt("{}").alias("pregunta"))


@query("SELECT unnest(['bajada', 'propia', 'favorito', 'rebaja']) AS palabra, 40::INT AS arranque")
def settings_merge(spark, sf):
    """Settings from JSON: lists get the defaults they lack, other kinds and unknown keys are dropped."""
    own = X.load_settings('{"incluye": ["bajada", "propia"], "arranque": "muchos", "otra": 1}', {"incluye": ["bajada", "favorito", "rebaja"], "arranque": 40})
    return spark.createDataFrame([(w, own["arranque"]) for w in own["incluye"]], "palabra string, arranque int")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS clave, CASE c_custkey % 3 WHEN 0 THEN 'viejo' WHEN 1 THEN 'nuevo' END AS cabecera FROM customer""")
def header_keys(spark, sf):
    """The header of a volume's text by its canonical title, else by the key it had before."""
    c = F.col("c_custkey")
    volumes = read(spark, sf, "customer").select(c.cast("string").alias("clave"), text("can", c).alias("canonico"), text("a", c).alias("autor"), text("o", c).alias("obras"))
    headers = read(spark, sf, "customer").where("c_custkey % 3 < 2").select(F.when(c % 3 == 0, text("a", c, " — o", c)).otherwise(text("can", c)).alias("canonico"), F.when(c % 3 == 0, "viejo").otherwise("nuevo").alias("estado"))
    return K.headers_by_key(headers, volumes).select("clave", F.col("cabecera.estado").alias("cabecera"))
