"""Alert history and price series: analytics, and DML as functions from state and batch to the new state.

Plain Parquet has no MERGE, so an update returns the state's new rows; callers write them to a new version of the table.  Series are
ordered by id, never by time.  Latest and first values come from min_by and max_by, which combine before the shuffle; a
window is used only where every row of a series is returned.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import clean_url, fold, fold_squeezed, series_key, strip

LOT_PREFIX = "lote::"
HISTORY_MAX, HISTORY_PRUNE = 1_000, 500


def lot_key(title: Column) -> Column:
    return F.concat(F.lit(LOT_PREFIX), series_key(title))


def is_lot(key: Column) -> Column:
    return F.startswith(key, F.lit(LOT_PREFIX))


# --- analytics --------------------------------------------------------------------------------------------------------


def series_titles(points: DataFrame, lots: bool = False) -> DataFrame:
    """(clave, titulo, n, last_id): each series with its latest title and number of points; order by last_id descending for recency."""
    own = points.where(is_lot(F.col("clave")) if lots else ~is_lot(F.col("clave")))
    return own.groupBy("clave").agg(F.max_by("titulo", "id").alias("titulo"), F.count("*").alias("n"), F.max("id").alias("last_id"))


def series_stats(points: DataFrame, lots: bool = False) -> DataFrame:
    """(clave, n, minimo, maximo, fecha, primero, ultimo) in one aggregation."""
    own = points.where(is_lot(F.col("clave")) if lots else ~is_lot(F.col("clave")))
    return own.groupBy("clave").agg(F.count("*").alias("n"), F.min("precio").alias("minimo"), F.max("precio").alias("maximo"), F.max("fecha").alias("fecha"), F.min_by("precio", "id").alias("primero"), F.max_by("precio", "id").alias("ultimo"))


def last_prices(points: DataFrame) -> DataFrame:
    return points.groupBy("clave").agg(F.max_by("precio", "id").alias("ultimo"))


def price_rises(points: DataFrame) -> DataFrame:
    """Points that are dearer than the one before them in their series."""
    before = F.lag("precio").over(Window.partitionBy("clave").orderBy("id"))
    return points.withColumn("anterior", before).where("precio > anterior")


def series_points(points: DataFrame, key: str) -> DataFrame:
    return points.where(F.col("clave") == key).select("fecha", "precio", "url", "id").orderBy("id")


def day_summary(history: DataFrame) -> DataFrame:
    """Per day: alerts by state and the best notified discount (the first of equals)."""
    best = F.when((F.col("estado") == "notificado") & F.col("descuento").isNotNull(), F.struct(F.col("descuento"), (-F.col("id")).alias("first")))
    return history.groupBy(F.to_date("fecha").alias("dia")).agg(
        F.count_if(F.col("estado") == "notificado").alias("notificados"),
        F.count_if(F.col("estado") == "ignorado").alias("ignorados"),
        F.count_if(F.col("estado") == "lote").alias("lotes"),
        F.max_by("titulo", best).alias("mejor_titulo"),
        F.max(best)["descuento"].alias("mejor_descuento"),
    )


def history_page(history: DataFrame, limit: int = 200, state: str | None = None) -> DataFrame:
    rows = history if state is None else history.where(F.col("estado") == state)
    return rows.orderBy(F.desc("id")).limit(limit)


def history_order(mode: str) -> list[Column]:
    """The orders of the alert list; missing numbers go last, ties by newest."""
    return {
        "newest": [F.desc("id")],
        "oldest": [F.asc("id")],
        "discount": [F.desc_nulls_last("descuento"), F.desc("id")],
        "least discount": [F.asc_nulls_last("descuento"), F.desc("id")],
        "cheapest": [F.asc_nulls_last("precio_new"), F.desc("id")],
        "dearest": [F.desc_nulls_last("precio_new"), F.desc("id")],
        "title": [fold(F.col("titulo")).asc_nulls_last(), F.desc("id")],
    }[mode]


def price_order(mode: str) -> list[Column]:
    """The orders of a list of series (last_id, ultimo): as stored (newest first), by the last price; without one it counts as -1."""
    price = F.coalesce("ultimo", F.lit(-1.0))
    return {"stored": [F.desc("last_id")], "dearest": [price.desc(), F.desc("last_id")], "cheapest": [price.asc(), F.desc("last_id")]}[mode]


def collection_order(mode: str) -> list[Column]:
    """The orders of the collection: by number, or those that are owned or wished first."""
    number = [F.asc_nulls_last("orden"), F.asc("fila")]
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).desc()
    return {"number": number, "owned": [flag("poseido"), *number], "wished": [flag("deseado"), *number]}[mode]


def daily_summary(history: DataFrame, meta: DataFrame, day: str, clock: str, at: str = "21:00") -> tuple[DataFrame, DataFrame]:
    """(summary to send, meta) of the day (yyyy-MM-dd): at most once a day, not before `at`, and none for a day without alerts."""
    key = "last_summary_date"
    if clock < at or not meta.where((F.col("clave") == key) & (F.col("valor") == day)).isEmpty():
        return day_summary(history.limit(0)), meta
    done = meta.where(F.col("clave") != key).unionByName(meta.sparkSession.createDataFrame([(key, day)], "clave string, valor string"))
    return day_summary(history.where(F.to_date("fecha") == day)).where("notificados + ignorados + lotes > 0"), done


def last_alerts(history: DataFrame, title: str, look_back: int = 500, limit: int = 3) -> DataFrame:
    """The newest alerts of a title among the newest look_back of all."""
    return history.orderBy(F.desc("id")).limit(look_back).where(F.col("titulo") == title).orderBy(F.desc("id")).limit(limit)


def mail_footprint(history: DataFrame, points: DataFrame, links: DataFrame, lots: DataFrame) -> DataFrame:
    """Per mail: rows it left in the history, the volumes' and the lots' series, and how many of its URLs are watched."""
    own = [
        history.select("mensaje_id", F.lit("historial").alias("kind"), F.col("enlace").alias("url")),
        points.select("mensaje_id", F.when(is_lot(F.col("clave")), "lotes").otherwise("precios").alias("kind"), "url"),
    ]
    rows = own[0].unionByName(own[1]).where("mensaje_id is not null").withColumn("limpia", clean_url(F.col("url")))
    counts = rows.groupBy("mensaje_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("historial", "precios", "lotes")])
    urls = rows.where("limpia <> ''").select("mensaje_id", "limpia").distinct()
    watched = [
        urls.join(table.select(clean_url(F.col("url")).alias("limpia")).distinct(), "limpia").groupBy("mensaje_id").agg(F.count("*").alias(name))
        for table, name in ((links, "enlaces"), (lots, "lotes_vigilados"))
    ]
    out = counts.join(watched[0], "mensaje_id", "left").join(watched[1], "mensaje_id", "left")
    return out.select("mensaje_id", "historial", "precios", "lotes", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("enlaces", "lotes_vigilados")])


# --- alerts -----------------------------------------------------------------------------------------------------------


def new_alerts(history: DataFrame, batch: DataFrame, order: str = "seq") -> DataFrame:
    """Rows of batch that history doesn't have yet by (mensaje_id, estado), each such pair once, the first in order; rows without
    mensaje_id always count as new."""
    named = batch.where("mensaje_id is not null")
    first = named.withColumn("__rank", F.row_number().over(Window.partitionBy("mensaje_id", "estado").orderBy(order))).where("__rank = 1").drop("__rank")
    fresh = first.join(history.select("mensaje_id", "estado").where("mensaje_id is not null").distinct(), ["mensaje_id", "estado"], "left_anti")
    return fresh.select(batch.columns).unionByName(batch.where("mensaje_id is null"))


def pruned_rows(total: int, most: int = HISTORY_MAX, prune: int = HISTORY_PRUNE) -> int:
    """How many of so many rows, inserted one by one, have gone: the oldest `prune` whenever there are over `most`."""
    return prune * -(-max(0, total - most) // prune)


def rotated(history: DataFrame, most: int = HISTORY_MAX, prune: int = HISTORY_PRUNE, total: int | None = None) -> DataFrame:
    """What is left of a history whose rows were inserted one by one in order of id, the oldest `prune` deleted whenever there are
    over `most`.  In closed form: how many went is known from the count (total, if it is known already), which ones from a threshold id."""
    total = history.count() if total is None else total
    gone = pruned_rows(total, most, prune)
    if not gone:
        return history
    # At most `most` rows stay, so the threshold is the least of that many newest ids: a bounded top-k, never a sort of the table.
    first_kept = history.select("id").orderBy(F.desc("id")).limit(total - gone).agg(F.min("id")).collect()[0][0]
    return history.where(F.col("id") >= first_kept)


def clear(table: DataFrame, state: str | None = None) -> DataFrame:
    return table.limit(0) if state is None else table.where(~F.coalesce(F.col("estado") == state, F.lit(False)))


# --- price points -----------------------------------------------------------------------------------------------------


def add_points(points: DataFrame, batch: DataFrame) -> DataFrame:
    """points after batch (clave, titulo, fecha, precio, url, mensaje_id, id; at most one row a key and mail; ids after those of points).

    A point that the series has from this mail is not added.  Else an identical point without a mail (same price and
    URL) is adopted: the lowest such id gets the mail.  Several mails adopt several points, in the order of their ids.
    Rows without mensaje_id are always added.
    """
    key = ["clave", "precio", "__url"]
    url = F.coalesce("url", F.lit("")).alias("__url")
    named = batch.where("mensaje_id is not null").withColumn("__turn", F.row_number().over(Window.partitionBy("clave", "mensaje_id").orderBy("id"))).where("__turn = 1").drop("__turn")
    fresh = named.join(points.where("mensaje_id is not null").select("clave", "mensaje_id").distinct(), ["clave", "mensaje_id"], "left_anti")
    claims = fresh.withColumn("__url", F.coalesce("url", F.lit(""))).withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy("id")))
    orphans = points.where("mensaje_id is null").select("clave", "precio", url, F.col("id").alias("__orphan"))
    numbered = orphans.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy("__orphan")))
    matched = claims.join(numbered, [*key, "__n"], "left")
    adopted = matched.where("__orphan is not null").select(F.col("__orphan").alias("id"), F.col("mensaje_id").alias("__mail"))
    kept = points.join(adopted, "id", "left").withColumn("mensaje_id", F.coalesce("mensaje_id", "__mail")).select(points.columns)
    added = matched.where("__orphan is null").select(points.columns)
    return kept.unionByName(added).unionByName(batch.where("mensaje_id is null").select(points.columns))


def changed_points(points: DataFrame, least: float = 0.01) -> DataFrame:
    """Points that differ from the one before them by at least `least`, and each series' first."""
    before = F.lag("precio").over(Window.partitionBy("clave").orderBy("id"))
    return points.withColumn("__before", before).where(F.col("__before").isNull() | (F.abs(F.col("precio") - F.col("__before")) >= least)).drop("__before")


def retract_points(points: DataFrame, sold: DataFrame) -> DataFrame:
    """points without those of sold listings: sold has (clave, url), compared by clean URL."""
    gone = sold.select("clave", clean_url(F.col("url")).alias("__clean")).where("clave is not null and __clean <> ''").distinct()
    return points.withColumn("__clean", clean_url(F.col("url"))).join(gone, ["clave", "__clean"], "left_anti").select(points.columns)


def rename_lot(points: DataFrame, lots: DataFrame, old_key: str, title: str) -> tuple[DataFrame, DataFrame]:
    """Series and watchers of a lot under a new title; a series that has it already is merged with."""
    if not old_key.startswith(LOT_PREFIX):
        raise ValueError(f"not the key of a lot: {old_key!r}")
    hit = F.col("clave") == old_key
    moved = points.withColumn("titulo", F.when(hit, title).otherwise(F.col("titulo"))).withColumn("clave", F.when(hit, lot_key(F.lit(title))).otherwise(F.col("clave")))
    return moved, lots.withColumn("titulo", F.when(lot_key(F.col("titulo")) == old_key, title).otherwise(F.col("titulo")))


def delete_lot(points: DataFrame, lots: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """A lot's series and every watcher that shares its key go."""
    if not key.startswith(LOT_PREFIX):
        raise ValueError(f"not the key of a lot: {key!r}")
    return points.where(F.col("clave") != key), lots.where(lot_key(F.col("titulo")) != key)


def seed_lots(points: DataFrame, history: DataFrame, seeded: bool) -> DataFrame:
    """Points from the history's lots, once."""
    if seeded:
        return points
    rows = history.where("estado = 'lote' and precio_new is not null").select("id", lot_key(F.col("titulo")).alias("clave"), "titulo", "fecha", F.col("precio_new").alias("precio"), F.col("enlace").alias("url"), "mensaje_id")
    return points.unionByName(rows.select(points.columns))


# --- watch lists ------------------------------------------------------------------------------------------------------


def watch(links: DataFrame, batch: DataFrame, owner: str | None = "numero") -> DataFrame:
    """links after batch (url, precio, seq and, for volumes, owner): one row a clean URL (and owner); the last price seen is taken
    where it isn't null, new URLs are stored clean, rows without a URL don't count."""
    keys = ["__clean", *([owner] if owner else [])]
    clean = batch.withColumn("__clean", clean_url(F.col("url"))).where("__clean <> ''")
    rest = [c for c in clean.columns if c not in {*keys, "url", "precio", "seq"}]
    seen = clean.groupBy(*keys).agg(F.max_by("precio", F.when(F.col("precio").isNotNull(), F.col("seq"))).alias("__price"), *[F.min_by(c, "seq").alias(f"__new_{c}") for c in rest])
    own = links.withColumn("__clean", clean_url(F.col("url"))).withColumn("__have", F.lit(True))
    both = own.join(seen, keys, "full_outer")
    out = []
    for c in links.columns:
        if c == "ultimo_precio":
            out.append(F.coalesce("__price", c).alias(c))
        elif c == "url":
            out.append(F.when(F.col("__have"), F.col("url")).otherwise(F.col("__clean")).alias("url"))
        elif f"__new_{c}" in both.columns:
            out.append(F.coalesce(c, f"__new_{c}").alias(c))
        else:
            out.append(F.col(c))
    return both.select(*out)


def mark_sold(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Listings whose id is in ids are sold and lose their price."""
    hit = table.join(ids.select("id").distinct().withColumn("__sold", F.lit(True)), "id", "left")
    return hit.withColumn("vendido", F.coalesce("__sold", "vendido", F.lit(False))).withColumn("ultimo_precio", F.when(F.col("__sold"), F.lit(None)).otherwise(F.col("ultimo_precio"))).select(table.columns)


def remove_watched(table: DataFrame, ids: DataFrame) -> DataFrame:
    """A watch list without the rows whose id is in ids."""
    return table.join(ids.select("id"), "id", "left_anti")


def update_watched(table: DataFrame, prices: DataFrame) -> DataFrame:
    """A watch list after prices (id, precio, fecha): the last price, null too, and when it was looked at."""
    new = prices.select("id", F.col("precio").alias("__precio"), F.col("fecha").alias("__fecha"), F.lit(True).alias("__seen"))
    both = table.join(new, "id", "left")
    taken = {"ultimo_precio": "__precio", "ultima_revision": "__fecha"}
    return both.select(*[F.when(F.col("__seen"), F.col(taken[c])).otherwise(F.col(c)).alias(c) if c in taken else F.col(c) for c in table.columns])


def watched_of(links: DataFrame, catalogue: DataFrame, key: str, row: str = "fila") -> DataFrame:
    """The links of one volume, by its number or else by its order, in order of id."""
    named = catalogue.where(F.col("numero") == key).select("numero").unionByName(first_number(catalogue, row).where(F.col("orden").cast("string") == key).select("numero"))
    own = named.withColumn("rank", (F.col("numero") != key).cast("int")).groupBy().agg(F.min_by("numero", "rank").alias("__numero"))
    return links.join(F.broadcast(own), links["numero"] == own["__numero"], "left_semi").orderBy("id")


def known(table: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of batch that table already has by keys: existence only, nothing of table is read but its keys."""
    return batch.join(table.select(*keys), keys, "left_semi")


def append_if_changed(points: DataFrame, seen: DataFrame, least: float = 0.01) -> DataFrame:
    """The rows of seen (clave, precio, ...) whose price differs from the last of their series, or whose series has none."""
    last = last_prices(points).withColumnRenamed("ultimo", "__last")
    return seen.join(last, "clave", "left").where(F.col("__last").isNull() | (F.abs(F.col("precio") - F.col("__last")) >= least)).drop("__last")


def lots_without_points(series: DataFrame, lots: DataFrame) -> DataFrame:
    """Series of lots, and watched lots that have none yet with no points."""
    own = lots.select(lot_key(F.col("titulo")).alias("clave"), "titulo").dropDuplicates(["clave"])
    return series.select("clave", "titulo", "n").unionByName(own.join(series, "clave", "left_anti").select("clave", "titulo", F.lit(0).cast("long").alias("n")))


# --- thresholds, key-value tables, processed mails --------------------------------------------------------------------


def set_thresholds(rows: DataFrame, order: str = "seq") -> DataFrame:
    """The whole table of thresholds from rows: trimmed, blanks dropped, the last of a pattern wins."""
    return rows.withColumn("patron", strip(F.col("patron"))).where("patron <> ''").groupBy("patron").agg(F.max_by("porcentaje", order).alias("porcentaje"))


def thresholds_for(titles: DataFrame, thresholds: DataFrame, title_col: str = "titulo", most: int = 10_000) -> DataFrame:
    """titles with the percentage of the longest pattern in them, null without one.  Patterns are taken in shares of about `most`, each looked for in one
    pass over the titles, so any number will do and no title is shuffled."""
    patterns = thresholds.select(fold(F.col("patron")).alias("p"), F.col("porcentaje").cast("double").alias("q")).where("p <> ''")
    shares = max(1, -(-patterns.count() // most))
    plain = titles.withColumn("__t", fold(F.col(title_col)))
    found = []
    for k in range(shares):
        own = patterns if shares == 1 else patterns.where(F.pmod(F.xxhash64("p"), F.lit(shares)) == k)
        # At most about `most` patterns come to the driver and go out as one sorted array, the longest first: no join.
        rows = sorted((-len(r["p"]), r["p"], r["q"]) for r in own.collect() if r["q"] is not None)
        if rows:
            every = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(p).alias("p"), F.lit(q).alias("q")) for n, p, q in rows]) if len(rows) <= 200 else F.from_json(F.lit(json.dumps([{"n": n, "p": p, "q": q} for n, p, q in rows])), "array<struct<n: int, p: string, q: double>>")
            plain = plain.withColumn(f"__h{k}", F.get(F.filter(every, lambda x: F.contains(F.col("__t"), x["p"])), F.lit(0)))
            found.append(F.col(f"__h{k}"))
    if not found:
        return titles.withColumn("porcentaje", F.lit(None).cast("double"))
    return plain.select(*titles.columns, F.get(F.array_sort(F.array_compact(F.array(*found))), F.lit(0))["q"].alias("porcentaje"))


def put_meta(meta: DataFrame, batch: DataFrame, order: str = "seq") -> DataFrame:
    """A key-value table after batch; the last of a key wins."""
    old = meta.select("clave", "valor", F.lit(None).cast("long").alias("__n"))
    new = batch.select("clave", "valor", F.col(order).cast("long").alias("__n"))
    return old.unionByName(new).groupBy("clave").agg(F.max_by("valor", F.coalesce("__n", F.lit(-1))).alias("valor"))


def mark_processed(done: DataFrame, batch: DataFrame) -> DataFrame:
    return done.unionByName(batch.select(done.columns)).dropDuplicates(["folder", "uid"])


def last_uid(done: DataFrame) -> DataFrame:
    return done.groupBy("folder").agg(F.max(F.col("uid").try_cast("bigint")).alias("ultimo"))


# --- catalogue tables -------------------------------------------------------------------------------------------------

CARRIED = ("poseido", "deseado", "precio_objetivo", "descripcion", "temas")


def reload_catalogue(old: DataFrame, new: DataFrame) -> DataFrame:
    """new catalogue rows with the marks, targets and descriptions that old has under the same numero."""
    marks = old.groupBy("numero").agg(F.max("poseido").alias("poseido"), F.max("deseado").alias("deseado"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.coalesce("orden", F.lit(0)))).alias(c) for c in CARRIED[2:]])
    joined = new.join(marks, "numero", "left")
    return joined.select(*new.columns, *[F.coalesce(c, F.lit(False)).alias(c) for c in CARRIED[:2]], *CARRIED[2:])


def first_number(catalogue: DataFrame, row: str = "fila") -> DataFrame:
    """(orden, numero): for each order, which volumes may share, the number of the first."""
    return catalogue.groupBy("orden").agg(F.min_by("numero", row).alias("numero"))


def backfill_links(links: DataFrame, catalogue: DataFrame, row: str = "fila") -> DataFrame:
    """links without a numero get that of the first volume of their orden."""
    first = first_number(catalogue, row).select("orden", F.col("numero").alias("__numero"))
    return links.join(first, "orden", "left").withColumn("numero", F.coalesce("numero", "__numero")).select(links.columns)


def set_fields(catalogue: DataFrame, changes: DataFrame, row: str = "fila") -> DataFrame:
    """catalogue after changes (key, field columns): key is a numero or an orden, a numero first; null fields are left as they are."""
    fields = [c for c in changes.columns if c != "key"]
    unknown = set(fields) - {*CARRIED, "desc_modelo"}
    if unknown:
        raise ValueError(f"not a field that can be set: {sorted(unknown)}")
    by_number = catalogue.select("numero").distinct().withColumn("__own", F.lit(True))
    resolved = changes.join(by_number, changes["key"] == by_number["numero"], "left").drop("numero")
    orders = first_number(catalogue, row).select(F.col("orden").cast("string").alias("__orden"), F.col("numero").alias("__first"))
    named = resolved.join(orders, resolved["key"] == orders["__orden"], "left").select(F.when(F.col("__own"), F.col("key")).otherwise(F.coalesce("__first", "key")).alias("numero"), *[F.col(c).alias(f"__{c}") for c in fields])
    return catalogue.join(named, "numero", "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in catalogue.columns])


def catalogue_order() -> list[Column]:
    return [F.asc_nulls_last("orden"), F.asc("fila")]


# --- catalogue search -------------------------------------------------------------------------------------------------

# Weights of the fields, and what a whole word counts.
FIELD_WEIGHTS = {"obras": 6.0, "autor": 4.0, "temas": 3.0, "notas": 1.5, "descripcion": 1.0, "numero": 5.0}
WHOLE_WORD = 1.6


def search_catalogue(catalogue: DataFrame, query: str, weights: dict[str, float] = FIELD_WEIGHTS, limit: int = 200, tie: list[Column] | None = None) -> DataFrame:
    """Rows in which all words of query occur, in any field, with their score `puntos` and the fields hit `campos`, best first."""
    from quire.functions.text import fold_words

    words = fold_words(query).split()
    if not words:
        return catalogue.limit(0).withColumn("puntos", F.lit(0.0)).withColumn("campos", F.array().cast("array<string>"))
    folded = catalogue.withColumns({f"__{c}": fold(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in weights})
    everything = F.concat_ws(" ", *[f"__{c}" for c in weights])
    for w in words:
        folded = folded.where(F.contains(everything, F.lit(w)))
    score, fields = F.lit(0.0), []
    for c, weight in weights.items():
        own = F.col(f"__{c}")
        for w in words:
            whole = F.array_contains(F.split(fold_squeezed(own), " "), w)
            score = score + F.when(F.contains(own, F.lit(w)), F.when(whole, weight * WHOLE_WORD).otherwise(weight)).otherwise(0.0)
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(own, F.lit(w))
        fields.append(F.when(hit, F.lit(c)))
    scored = folded.select(*catalogue.columns, score.alias("puntos"), F.sort_array(F.array_compact(F.array(*fields))).alias("campos"))
    last = tie if tie is not None else [F.coalesce(F.nullif(F.col("orden"), F.lit(0)), F.lit(9999))]
    return scored.orderBy(F.desc("puntos"), *last).limit(limit)
