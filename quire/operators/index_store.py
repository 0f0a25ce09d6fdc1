"""The full-text index of a folder of volumes, kept up to date by whole volumes.

An index is a folder of generations.  A run reads the volumes that are new or changed against the manifest, and writes
their passages, postings and names as a generation of its own; the manifest, a small table of volumes, says which generation of a
volume counts, so replacing or dropping a volume rewrites nothing.  A run's manifest is written last: until then the one before
counts.  Postings of a generation are dealt to parts by the first two letters of their term (search.part_of), so a term or a prefix lists one part of each.

Generations have levels.  When FANOUT of one level hold volumes that count, these volumes' rows are merged into one generation of the next level, in
order of the term, and the manifest names that one; so after n runs some FANOUT * log(n) generations are left, and a row is rewritten log(n) times.
Rows of volumes that were replaced or dropped are left behind in it.  compact() removes generations without a volume that counts; a run
calls it after COMPACT_AFTER volumes, and after it has merged.

A passage's id has its generation, the task that wrote it and its place in that task, so no two have the same, and it is kept when generations are
merged.  A run shuffles no text and no postings: pages are cut and numbered where they are read, and a task writes the postings of its own passages to all
parts, sorted by the term within runs of passages.  Only merging deals them anew.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import fold
from quire.operators.search import Index, deal, load_names, part_of, passages, postings_in_runs
from quire.session import setting, shuffles_dropped
from quire.sources.tables import BROADCAST_VOLUMES, read_lines

COMPACT_AFTER = 20
FANOUT, PARTS = 4, 16
#: An id is generation << 44 | task << 26 | place: a run has at most 262,144 tasks, a task 67,108,864 passages.
TASK_BITS, PLACE_BITS = 18, 26
#: Bytes of a row group of postings: a task has one of each part in memory.
GROUP_BYTES = 8 << 20
MANIFEST = "archivo string, mtime timestamp, bytes long, canonico string, autor string, numero string, orden int, pasajes long, nombres long, palabras long, generacion int, fichas long, nivel int"
TABLES = ("pasajes", "postings", "nombres")


@dataclass
class Counters:
    """What a run did: volumes read, files seen, passages and names written, volumes unchanged, dropped, and lines that couldn't be read."""

    tomos: int = 0
    total: int = 0
    pasajes: int = 0
    nombres: int = 0
    saltados: int = 0
    borrados: int = 0
    errores: int = 0

    def row(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(asdict(self).values())], ", ".join(f"{n} long" for n in asdict(self)))


class Store:
    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT) -> None:
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def run(self) -> int:
        """The number of the last run whose manifest is whole."""
        path, fs = self._fs()
        root = path(f"{self.path}/manifiesto")
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return max((int(n[4:]) for n in names if n.startswith("run-") and fs.exists(path(f"{self.path}/manifiesto/{n}/_SUCCESS"))), default=-1)

    def manifest(self) -> DataFrame:
        last = self.run()
        return self.spark.createDataFrame([], MANIFEST) if last < 0 else self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifiesto/run-{last}")

    def volumes(self) -> DataFrame:
        """The volumes in the order of the collection."""
        return self.manifest().orderBy(F.col("orden").asc_nulls_first(), "canonico").select("canonico", "autor", "numero", "orden", "pasajes", "nombres", "palabras")

    def table(self, name: str) -> DataFrame:
        """The rows of passages, postings or names that count: those of each volume's generation."""
        live = self.manifest().select("archivo", "generacion")
        if live.limit(BROADCAST_VOLUMES + 1).count() <= BROADCAST_VOLUMES:
            live = F.broadcast(live)
        return self.spark.read.parquet(f"{self.path}/{name}").join(live, ["archivo", "generacion"], "left_semi")

    def index(self) -> Index:
        """For the queries of search.py.  The numbers of the whole index come from the manifest."""
        total = self.manifest().agg(F.coalesce(F.sum("pasajes"), F.lit(0)).alias("n"), F.coalesce(F.sum("fichas"), F.lit(0)).alias("fichas")).collect()[0]
        return Index(total["n"], total["fichas"] / total["n"] if total["fichas"] else 1.0, table=self.table("postings"), parts=PARTS)

    def update(self, source: str, force: bool = False) -> Counters:
        """Read the volumes below source (JSON lines) that are new or changed, all of them with force; drop those whose file is gone."""
        last = self.run()
        generation = last + 1
        known = self.manifest()
        headers, pages, bad = read_lines(self.spark, source)
        # A volume that Spark wrote is a folder: its name stays when it is written again.
        named = F.coalesce(F.nullif(F.regexp_extract("archivo", "archivo=([^/]+)/", 1), F.lit("")), F.col("archivo"))
        headers, pages = headers.withColumn("archivo", named), pages.withColumn("archivo", named)
        keys = ["archivo", "mtime", "bytes"]
        files = headers.dropDuplicates(["archivo"]).persist()
        fresh = files if force else files.join(known.select(*keys), keys, "left_anti")
        fresh = fresh.withColumn("indice_nombres", F.coalesce("indice_nombres", F.create_map().cast("map<string, array<string>>"))).persist()
        few = fresh.limit(BROADCAST_VOLUMES + 1).count() <= BROADCAST_VOLUMES
        sent = lambda rows: F.broadcast(rows) if few else rows
        own = pages.join(sent(fresh.select("archivo", "canonico")), "archivo").withColumnRenamed("pdf", "hoja")
        cut = passages(own, ["archivo", "canonico", "hoja", "titulo", "obra"])
        # The rows of a task are numbered where they are cut, so no passage is shuffled for it.
        rows = cut.withColumn("__row", F.monotonically_increasing_id())
        self._add("pasajes", rows.withColumns({"generacion": F.lit(generation), "id": _number(generation, F.col("__row"))}).drop("__row"))
        stored = self.spark.read.parquet(f"{self.path}/pasajes").where(F.col("generacion") == generation)
        # Files of a run in one small window.  A posting carries its volume's number, not its name, to where it is written.
        volume = fresh.select("archivo", F.row_number().over(Window.orderBy("archivo")).alias("__volume"))
        found = postings_in_runs(stored.join(sent(volume), "archivo").withColumn("id", F.struct("id", "__volume")))
        found = found.select("term", F.col("id.id").alias("id"), "tf", "positions", "dl", F.col("id.__volume").alias("__volume")).join(sent(volume), "__volume").drop("__volume")
        self._add("postings", found.withColumn("generacion", F.lit(generation)), deal_anew=False)
        self._add("nombres", load_names(fresh, ["archivo", "canonico"]).withColumn("generacion", F.lit(generation)))
        words = self.spark.read.parquet(f"{self.path}/postings").where(F.col("generacion") == generation).groupBy("archivo").agg(F.sum("tf").alias("fichas"))
        counts = stored.groupBy("archivo").agg(F.count("*").alias("pasajes"), F.sum("palabras").alias("__p"))
        names = self.spark.read.parquet(f"{self.path}/nombres").where(F.col("generacion") == generation).groupBy("archivo").agg(F.count("*").alias("nombres"))
        new = fresh.drop("palabras").join(counts, "archivo", "left").join(names, "archivo", "left").join(words, "archivo", "left").select(*keys, "canonico", "autor", "numero", "orden", F.coalesce("pasajes", F.lit(0)).alias("pasajes"), F.coalesce("nombres", F.lit(0)).alias("nombres"), F.coalesce("__p", F.lit(0)).alias("palabras"), F.lit(generation).alias("generacion"), F.coalesce("fichas", F.lit(0)).alias("fichas"), F.lit(0).alias("nivel"))
        kept = known.join(files.select(*keys), keys, "left_semi")
        if force:
            kept = kept.limit(0)
        self._publish(kept.unionByName(new), generation)
        written = self.manifest().where(F.col("generacion") == generation).agg(F.count("*").alias("t"), F.coalesce(F.sum("pasajes"), F.lit(0)).alias("p"), F.coalesce(F.sum("nombres"), F.lit(0)).alias("n")).collect()[0]
        gone = known.select("archivo").distinct().join(files.select("archivo"), "archivo", "left_anti").count()
        total = files.count()
        out = Counters(written["t"], total, written["p"], written["n"], total - written["t"], gone, bad.count())
        files.unpersist()
        fresh.unpersist()
        if self.merge() or (out.tomos >= COMPACT_AFTER and generation):
            self.compact()
        return out

    def _add(self, name: str, rows: DataFrame, deal_anew: bool = True) -> None:
        """Write rows of a generation; what a run that was stopped has left of it goes first.  Postings that aren't dealt anew go from each task to all
        parts, in the order in which they come."""
        path, fs = self._fs()
        generation = self.run() + 1
        fs.delete(path(f"{self.path}/{name}/generacion={generation}"), True)
        if name != "postings":
            with shuffles_dropped(self.spark):
                rows.write.option("compression", "zstd").partitionBy("generacion").parquet(f"{self.path}/{name}", mode="append")
            return
        parted = rows.withColumn("part", part_of(F.col("term"), PARTS))
        if not deal_anew:
            # A writer a part: else each task would sort its rows by part.
            with setting(self.spark, "spark.sql.maxConcurrentOutputFileWriters", str(2 * PARTS)):
                parted.write.options(compression="zstd", **{"parquet.block.size": GROUP_BYTES}).partitionBy("generacion", "part").parquet(f"{self.path}/{name}", mode="append")
            return
        # The generation's passages are written before its postings.
        passages = self.spark.read.parquet(f"{self.path}/pasajes").where(F.col("generacion") == generation).count()
        dealt = deal(parted, "id", PARTS, passages).sortWithinPartitions("generacion", "part", "term", "id")
        with shuffles_dropped(self.spark):
            dealt.write.option("compression", "zstd").partitionBy("generacion", "part").parquet(f"{self.path}/{name}", mode="append")

    def _publish(self, volumes: DataFrame, run: int) -> None:
        volumes.coalesce(1).write.parquet(f"{self.path}/manifiesto/run-{run}", mode="overwrite")

    def merge(self) -> int:
        """Merge the generations of each level that is full into one of the next; how many were written."""
        done = 0
        while True:
            manifest = self.manifest()
            levels = manifest.groupBy("nivel").agg(F.countDistinct("generacion").alias("n")).where(F.col("n") >= self.fanout)
            level = levels.agg(F.min("nivel")).collect()[0][0]
            if level is None:
                return done
            target = self.run() + 1
            own = manifest.where(F.col("nivel") == level).select("archivo", "generacion")
            old = [r["generacion"] for r in own.select("generacion").distinct().collect()]  # a few numbers
            for name in TABLES:
                rows = self.spark.read.parquet(f"{self.path}/{name}").where(F.col("generacion").isin(*old))
                live = F.broadcast(own) if own.limit(BROADCAST_VOLUMES + 1).count() <= BROADCAST_VOLUMES else own
                self._add(name, rows.join(live, ["archivo", "generacion"], "left_semi").withColumn("generacion", F.lit(target)).drop("part"))
            moved = F.col("nivel") == level
            self._publish(manifest.withColumn("generacion", F.when(moved, F.lit(target)).otherwise(F.col("generacion"))).withColumn("nivel", F.when(moved, F.col("nivel") + 1).otherwise(F.col("nivel"))), target)
            done += 1

    def compact(self) -> None:
        """Give back what replaced and dropped volumes hold: generations without a volume that counts go, those with one are kept whole."""
        path, fs = self._fs()
        live = {r["generacion"] for r in self.manifest().select("generacion").distinct().collect()}  # at most one a run
        for name in TABLES:
            root = path(f"{self.path}/{name}")
            for status in fs.listStatus(root) if fs.exists(root) else []:
                folder = status.getPath().getName()
                if folder.startswith("generacion=") and int(folder.split("=")[1]) not in live:
                    fs.delete(status.getPath(), True)


def _number(generation: int, row: Column) -> Column:
    """The id of a passage by the number that Spark gives its row, task << 33 | place."""
    task, place = F.shiftright(row, 33), row.bitwiseAND(F.lit((1 << 33) - 1))
    whole = F.lit(generation).cast("long") * (1 << TASK_BITS + PLACE_BITS) + task * (1 << PLACE_BITS) + place
    return F.when((task < 1 << TASK_BITS) & (place < 1 << PLACE_BITS), whole).otherwise(F.raise_error(F.lit("more passages of a run or a task than ids")).cast("long"))


def joined_names(names: DataFrame, volumes: DataFrame) -> DataFrame:
    """Names with their volume's author, number and place in the collection."""
    return names.join(volumes.select("canonico", "autor", "numero", "orden"), "canonico")


def alphabetical(volumes: DataFrame) -> DataFrame:
    """Volumes by their canonical title without accents."""
    return volumes.orderBy(fold(F.col("canonico")), "canonico")
