"""Prices as a keyed stream: what a series' last price was, which mails it has seen, and which were asked for again.

Each series (clave) keeps its own state in the state store: the last price and its title, the mails whose points it has, and the replays that were served.
A batch touches the series of its own rows alone, whatever the stream has seen before, and a restart goes on from the checkpoint.

A point of a mail that the series has is known: it comes out as `again` and changes nothing.  Asked for again (replay) it comes out as `replayed`, is
judged against the last price, and changes nothing either; the same request (mail, seq) is served once.  Any other point is `new` and becomes the last
price.  `risen` says that the price is above the last one.

Within a batch the rows of a series are taken in order of seq, so a series' rows of one batch are held in one task: bound a batch by the source's
maxFilesPerTrigger or maxBytesPerTrigger.  Rows without a series are no points and don't come out; a null price is an error of the mail and doesn't either; rows without a mail are
always new.  `judged` is the same step over a whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.session import carry

carry(__name__)

#: Columns that a stream of points has, and those that come out.
POINT = "clave string, titulo string, precio double, mensaje_id string, seq long, replay boolean"
OUT = "clave string, titulo string, precio double, mensaje_id string, seq long, estado string, anterior double, risen boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Mails of a series that are kept with its last price; of more, all go to the map.
RECENT = 64
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


_OUT = [c.split()[0] for c in OUT.split(", ")]


def _in_order(row: Row) -> tuple:
    """By seq, replay, mail and price; nulls, and prices that are no number, first."""
    _, _, price, mail, seq, replay = row
    return seq is not None, seq or 0, replay, mail is not None, mail or "", price == price, price


class LastPrice(StatefulProcessor):
    """State variables of one series: its last price with its newest mails, up to RECENT of them, the mails before those, and the replays served."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "precio double, recent array<string>, more boolean")
        self.mails = handle.getMapState("mails", "mensaje_id string", "known boolean")
        self.served = handle.getMapState("served", "mensaje_id string, seq long", "seq long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        kept = self.last.get()  # a call of the state store costs more than a row
        last, more = (kept[0], kept[2]) if kept else (None, False)
        recent, changed = dict.fromkeys(kept[1] if kept else ()), False
        for _, title, price, mail, seq, replay in sorted(rows, key=_in_order):
            if mail is not None and (mail in recent or (more and self.mails.containsKey((mail,)))):
                state = "replayed" if replay else "again"
                if replay:
                    if self.served.containsKey((mail, seq)):
                        continue
                    self.served.updateValue((mail, seq), (seq,))
            else:
                state = "new"
                if mail is not None:
                    recent[mail] = None
            yield Row(*_OUT)(key[0], title, price, mail, seq, state, last, last is not None and price > last)
            if state == "new":
                last, changed = price, True
        if len(recent) > RECENT:
            for mail in recent:
                self.mails.updateValue((mail,), (True,))
            recent, more = {}, True
        if changed:
            self.last.update((last, list(recent), more))

    def close(self) -> None:
        pass


def _points(rows: DataFrame) -> DataFrame:
    replay = F.coalesce("replay", F.lit(False)).alias("replay")
    return rows.where("clave is not null and precio is not null").select("clave", "titulo", F.col("precio").cast("double").alias("precio"), "mensaje_id", F.col("seq").cast("long").alias("seq"), replay)


def judged_stream(points: DataFrame) -> DataFrame:
    """A stream of points (POINT) as OUT."""
    return _points(points).groupBy("clave").transformWithState(LastPrice(), OUT, "Append", "None")


def start(points: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Write the judged points below path, exactly once each: until the source is read, or, with `every` ("30 seconds"), for good.  The state is kept by RocksDB;
    the session's own provider holds for other streams."""
    spark: SparkSession = points.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKS)
    try:  # a query takes the session's settings when it starts
        trigger = {"processingTime": every} if every else {"availableNow": True}
        return judged_stream(points).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    finally:
        spark.conf.set(_PROVIDER, before)


def judged(points: DataFrame) -> DataFrame:
    """All points at once, in order of seq: what the stream makes of them, however they are dealt to batches."""
    order: list[Column] = [F.asc("seq"), F.asc("replay"), F.asc_nulls_first("mensaje_id"), F.asc("precio")]
    rows = _points(points).withColumn("__n", F.row_number().over(Window.partitionBy("clave", "mensaje_id").orderBy(*order)))
    known = F.col("mensaje_id").isNotNull() & (F.col("__n") > 1)
    marked = rows.withColumn("estado", F.when(~known, "new").when(F.col("replay"), "replayed").otherwise("again"))
    served = marked.withColumn("__r", F.row_number().over(Window.partitionBy("clave", "mensaje_id", "seq", "estado").orderBy(*order))).where("estado <> 'replayed' or __r = 1")
    before = F.last(F.when(F.col("estado") == "new", F.col("precio")), ignorenulls=True).over(Window.partitionBy("clave").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return served.withColumn("anterior", before).select("clave", "titulo", "precio", "mensaje_id", "seq", "estado", "anterior", F.coalesce(F.col("precio") > F.col("anterior"), F.lit(False)).alias("risen"))
