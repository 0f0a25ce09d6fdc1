"""Adaptive time partitions: a table laid out by moments in files of bounded size, and laid out anew when rows arrive.

Years that hold over `limit` rows are split into all their months, those into days, those into hours.  In order of time, siblings within the
limit join into runs.  A leaf is a run that has rows, an hour above the limit, or all rows without a moment; its rows, in order, fill parts
of `limit` rows, each a Parquet file at leaf=.../part=....

The plan comes from a histogram by hour.  applyInPandas plans months, days and hours inside each year's histogram independently (8,784 counts at most,
whatever the number of rows); a final small pass folds the years, and the subplans of years that aren't split are dropped.  What is sent to all tasks
is the plan, one row an hour that has rows: it grows with the time that the table spans, not with its rows.

Leaves within the limit are shuffled once, by leaf.  Those above it, which may hold any share of the table, are dealt by ranges of the whole order, so no
task gets more than its share however many rows have one moment; a second shuffle brings the rows of one file together.

A layout is rewritten from the same histogram with old and new rows counted apart.  A leaf of both plans without new rows is not even read, its
files stay.  Of a leaf above the limit the parts in front of its first new row stay; a part behind it can only recur if all its rows are
equal, and is then compared with its file.  Everything else is written anew before the obsolete files are removed, so a run that
is stopped in between loses no row; it is repeated in another folder.

Rows without a moment are a leaf of their own, named `null`; nulls sort first.  Rows that are equal in the order are told apart by all other columns (those
of types that can't be sorted excepted), repeated rows are all kept.  Of an empty table nothing is written, and reading gives no rows.
Columns may have any names: rows travel as structs, and the folders' names avoid those of the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from quire.llm.storage import cut, partitions

#: Hours in a plan that is broadcast (some 60 bytes each); a longer one, of over 100 years without an empty hour, is joined by a shuffle.
BROADCAST_HOURS = 1_000_000
NULL_LEAF = "null"
_MONTHS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


# --- the plan ---------------------------------------------------------------------------------------------------------


def runs(sizes: list[int], limit: int) -> list[list[int]]:
    """[first, last, rows] of the runs of siblings; one above the limit is alone."""
    out: list[list[int]] = []
    open_run = False
    for i, n in enumerate(sizes):
        if n > limit:
            out.append([i, i, n])
            open_run = False
        elif open_run and out[-1][2] + n <= limit:
            out[-1][1:] = [i, out[-1][2] + n]
        else:
            out.append([i, i, n])
            open_run = True
    return out


def year_plan(year: int, hours: np.ndarray, limit: int) -> np.ndarray:
    """The leaf of each hour of a year that is split."""
    leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
    days = [n + (leap and m == 1) for m, n in enumerate(_MONTHS)]
    names = np.empty(len(hours), dtype=object)

    def split(prefix: str, edges: np.ndarray, base: int) -> None:
        """Children between the edges (hours), numbered from base."""
        for a, b, n in runs(np.add.reduceat(hours[edges[0] : edges[-1]], edges[:-1] - edges[0]).tolist(), limit):
            lo, hi = edges[a], edges[b + 1]
            if n <= limit or hi - lo == 1:
                names[lo:hi] = f"{prefix}/{a + base:02d}-{b + base:02d}"
            else:
                split(f"{prefix}/{a + base:02d}", np.arange(lo, hi + 1, 24 if hi - lo > 24 else 1), 1 if hi - lo > 24 else 0)

    split(f"{year:04d}", 24 * np.concatenate([[0], np.cumsum(days)]), 1)
    return names


def fold_years(sizes: dict[int, int], limit: int) -> dict[int, str]:
    """The leaf of each year within the limit; years that aren't named are empty."""
    run, before, owner = None, None, {}
    for year in sorted(sizes):
        if before is not None and year > before + 1:  # empty years go with the run before them, or start one
            run = run or [before + 1, year - 1, 0]
            run[1] = year - 1
        if sizes[year] > limit:
            run = None
        else:
            if run is not None and run[2] + sizes[year] <= limit:
                run[1:] = [year, run[2] + sizes[year]]
            else:
                run = [year, year, sizes[year]]
            owner[year] = run
        before = year
    return {year: f"{r[0]:04d}-{r[1]:04d}" for year, r in owner.items()}


def plan(sizes: DataFrame, limit: int) -> DataFrame:
    """(year, slot, leaf, size, same, stays) for each hour of sizes (year, slot, n, fresh: how many of the n are new): its leaf with all rows
    and the leaf's rows; whether the layout without the new rows has a leaf of this name (same), and has it with the same rows (stays)."""

    def months_days_hours(of_year: pd.DataFrame) -> pd.DataFrame:
        of_year = of_year.reset_index(drop=True)
        year = int(of_year["year"][0])
        slots = of_year["slot"].to_numpy()
        leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)

        def leaves(rows: np.ndarray) -> np.ndarray:
            hours = np.zeros(24 * (365 + leap), np.int64)
            hours[slots] = rows
            return year_plan(year, hours, limit)[slots]

        n, fresh = of_year["n"].to_numpy(), of_year["fresh"].to_numpy()
        return of_year.assign(leaf=leaves(n), was=leaves(n - fresh))

    def years(totals: pd.DataFrame) -> pd.DataFrame:
        named = {c: fold_years({y: int(n) for y, n in zip(totals["year"].tolist(), totals[c].tolist(), strict=True) if n}, limit) for c in ("n", "old")}
        return pd.DataFrame({"year": totals["year"], "run": totals["year"].map(named["n"]), "run_was": totals["year"].map(named["old"])}).astype({"run": object, "run_was": object})

    subplans = cut(sizes.where("slot >= 0").groupBy("year").applyInPandas(months_days_hours, "year int, slot int, n long, fresh long, leaf string, was string"))
    totals = subplans.groupBy("year").agg(F.sum("n").alias("n"), F.sum(F.col("n") - F.col("fresh")).alias("old"))
    folded = totals.groupBy(F.lit(0).alias("all")).applyInPandas(years, "year int, run string, run_was string")
    hours = subplans.join(F.broadcast(folded), "year").select("year", "slot", "n", "fresh", F.coalesce("run", "leaf").alias("leaf"), F.coalesce("run_was", "was").alias("was"))
    none = sizes.where("slot < 0").select("year", "slot", "n", "fresh", F.lit(NULL_LEAF).alias("leaf"), F.lit(NULL_LEAF).alias("was"))
    every = cut(hours.unionByName(none))
    # A name says which hours a leaf has, so a leaf of the same name has the same hours.
    leaves = every.groupBy("leaf").agg(F.sum("n").alias("size"), F.sum("fresh").alias("fresh"), F.coalesce(F.bool_and(F.when(F.col("n") > F.col("fresh"), F.col("leaf") == F.col("was"))), F.lit(False)).alias("same"))
    return cut(every.select("year", "slot", "leaf").join(leaves, "leaf").select("year", "slot", "leaf", "size", "same", (F.col("same") & (F.col("fresh") == 0)).alias("stays")))


# --- rows and files ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """How a table is laid out below a folder: by the column `moment`, in `order`, in files of at most `limit` rows."""

    path: str
    moment: Column
    order: list[str]
    limit: int

    def names(self, columns: list[str]) -> tuple[str, str]:
        """The folders' keys: leaf and part, or what comes next that no column is called."""
        taken, out = {c.lower() for c in columns}, []
        for name in ("leaf", "part"):
            while name in taken:
                name += "_"
            out.append(name)
        return out[0], out[1]

    def read(self, spark: SparkSession, schema: StructType) -> DataFrame:
        """(file, index, row) and the leaf and part of each row that is stored; schema is the table's."""
        leaf, part = self.names(schema.names)
        stored = spark.read.schema(StructType([*schema.fields, StructField(leaf, StringType()), StructField(part, IntegerType())])).parquet(self.path)
        place = stored.metadataColumn("_metadata")
        return stored.select(place["file_path"].alias("file"), place["row_index"].alias("index"), F.translate(stored[leaf], ".", "/").alias("leaf"), stored[part].alias("part"), F.struct(*[stored[_quoted(c)] for c in schema.names]).alias("row"))

    def files(self, spark: SparkSession, schema: StructType) -> DataFrame:
        """(leaf, part, file), one row a file."""
        return self.read(spark, schema).select("leaf", "part", "file").distinct()

    def columns(self, spark: SparkSession, schema: StructType) -> list[str]:
        """The columns that the files have."""
        keys = self.names(schema.names)
        return [c for c in spark.read.parquet(self.path).columns if c not in keys]

    def _keyed(self, rows: DataFrame, new: Column) -> DataFrame:
        """(row, m, new, year, slot): the hour of the year; without a moment it is -1."""
        own = rows.select(F.struct(*[F.col(_quoted(c)) for c in rows.columns]).alias("row"), self.moment.alias("m"), F.coalesce(new, F.lit(False)).alias("new"))
        slot = (F.dayofyear("m") - 1) * 24 + F.hour("m")
        return own.withColumns({"year": F.coalesce(F.year("m"), F.lit(0)), "slot": F.coalesce(slot, F.lit(-1))})

    def _sorting(self, schema: StructType) -> list[Column]:
        """The order, made a total one by the other columns."""
        able = [f.name for f in schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
        return [F.col("m"), *[F.col("row").getField(c) for c in [*self.order, *[c for c in able if c not in self.order]]]]

    def _store(self, placed: DataFrame, schema: StructType, order: list[Column]) -> None:
        """Write rows (row, leaf, part, and what the order needs): each leaf and part in one task, in order, as one file."""
        # Spark's writer sorts by the folders' columns, and loses the order, unless it sees that rows come so; hence these are made first and never null.
        keyed = placed.withColumns({"__leaf": F.coalesce(F.translate("leaf", "/", "."), F.lit("")), "__part": F.coalesce(F.col("part").cast("int"), F.lit(0))})
        sorted_rows = keyed.repartition(partitions(placed.sparkSession), "__leaf", "__part").sortWithinPartitions("__leaf", "__part", *order)
        leaf, part = self.names(schema.names)
        sorted_rows.select(*[F.col("row").getField(c).alias(c) for c in schema.names], F.col("__leaf").alias(leaf), F.col("__part").alias(part)).write.mode("append").partitionBy(leaf, part).parquet(self.path)

    def _large(self, rows: DataFrame, schema: StructType) -> DataFrame:
        """Rows of leaves above the limit with their `at` (orders them), `position` in the leaf from 0, and part."""
        n = partitions(rows.sparkSession)
        # Equal rows can't be told apart, so any number will do to deal them out.
        own = [F.col("leaf"), *self._sorting(schema), F.col("salt")]
        dealt = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(n, *own).sortWithinPartitions(*own)
        sorted_rows = cut(dealt.select("row", "leaf", "same", "new", F.monotonically_increasing_id().alias("at")).withColumn("piece", F.shiftright("at", 33)))
        pieces = sorted_rows.groupBy("piece", "leaf").agg(F.min("at").alias("first"), F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("leaf").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = pieces.select("piece", "leaf", (before - F.col("first")).alias("shift"))  # a row for each task, and one for each leaf at most
        placed = sorted_rows.join(F.broadcast(starts), ["piece", "leaf"]).withColumn("position", F.col("at") + F.col("shift"))
        return placed.withColumn("part", F.floor(F.col("position") / F.lit(self.limit)).cast("int") + 1).drop("piece", "shift")

    def _recurring(self, large: DataFrame, schema: StructType) -> DataFrame:
        """(leaf, part) of leaves above the limit whose files have just these rows already."""
        spark = large.sparkSession
        likeness = F.xxhash64(*[F.col("row").getField(f.name) for f in schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()])
        parts = large.where("same").groupBy("leaf", "part").agg(F.count_if("new").alias("fresh"), F.min(F.when(F.col("new"), F.col("position"))).alias("first"), F.min(likeness).alias("lo"), F.max(likeness).alias("hi"))
        parts = cut(parts.withColumn("first", F.min("first").over(Window.partitionBy("leaf"))))
        ahead = F.col("first").isNull() | (F.col("part") * F.lit(self.limit) <= F.col("first"))
        kept = parts.where(ahead).select("leaf", "part")
        equal = parts.where(~ahead & (F.col("fresh") == 0) & (F.col("lo") == F.col("hi"))).select("leaf", "part")
        if equal.isEmpty():
            return kept

        def ends(rows: DataFrame) -> DataFrame:
            text = F.to_json("row")
            return rows.join(F.broadcast(equal), ["leaf", "part"], "left_semi").groupBy("leaf", "part").agg(F.count("*").alias("n"), F.min(text).alias("lo"), F.max(text).alias("hi"))

        return kept.unionByName(ends(large).join(ends(self.read(spark, schema)), ["leaf", "part", "n", "lo", "hi"], "left_semi").where("lo = hi").select("leaf", "part"))

    def _lay_out(self, rows: DataFrame, new: Column, rewrite: bool) -> DataFrame | None:
        """Write what doesn't stay; (leaf, part) of the files that do: a part of 0 stands for all of a leaf."""
        schema = rows.schema
        keyed = self._keyed(rows, new)
        sizes = keyed.groupBy("year", "slot").agg(F.count("*").alias("n"), F.count_if("new").alias("fresh"))
        hours = plan(cut(sizes), self.limit)
        if not rewrite:
            hours = hours.withColumns({"same": F.lit(False), "stays": F.lit(False)})
        wanted = hours.where(~F.col("stays")).drop("stays")
        if wanted.limit(BROADCAST_HOURS + 1).count() <= BROADCAST_HOURS:
            wanted = F.broadcast(wanted)
        placed = keyed.join(wanted, ["year", "slot"])
        small = placed.where(F.col("size") <= self.limit)
        self._store(small.withColumn("part", F.when(F.col("size") > 0, 1)), schema, self._sorting(schema))
        staying = hours.where("stays").select("leaf", F.lit(0).alias("part")).distinct()
        if not hours.where(~F.col("stays") & (F.col("size") > self.limit)).isEmpty():
            large = self._large(placed.where(F.col("size") > self.limit), schema)
            if rewrite:
                parts = cut(self._recurring(large, schema))
                staying = staying.unionByName(parts)
                large = large.join(F.broadcast(parts), ["leaf", "part"], "left_anti")
            self._store(large, schema, [F.col("at")])
        return staying

    def write(self, rows: DataFrame) -> None:
        """Lay out a table below the path, which holds nothing yet."""
        self._lay_out(rows, F.lit(False), rewrite=False)

    def rewrite(self, rows: DataFrame, new: Column) -> DataFrame:
        """Lay out all rows below the path, which holds a layout of those that aren't new; (leaf, part, file) of the files that stayed."""
        spark = rows.sparkSession
        before = cut(self.files(spark, rows.schema))
        staying = cut(self._lay_out(rows, new, rewrite=True).withColumnsRenamed({"leaf": "l", "part": "p"}))
        both = before.join(staying, (F.col("leaf") == F.col("l")) & ((F.col("p") == 0) | (F.col("p") == F.col("part"))), "left")
        judged = cut(both.select("leaf", "part", "file", F.col("l").isNotNull().alias("stayed")))
        _remove(spark, judged.where(~F.col("stayed")).select("file"))
        return judged.where("stayed").select("leaf", "part", "file")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _remove(spark: SparkSession, files: DataFrame) -> None:
    """Remove files, and folders that are empty then; their names come to the driver partition by partition."""
    jvm = spark._jvm
    path, uri = jvm.org.apache.hadoop.fs.Path, jvm.java.net.URI
    for row in files.toLocalIterator():
        file = path(uri(row["file"]))
        fs = file.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.delete(file, False)
        for folder in (file.getParent(), file.getParent().getParent()):
            if len(fs.listStatus(folder)):
                break
            fs.delete(folder, False)


def file_digests(layout: Layout, spark: SparkSession, schema: StructType, id_col: str, new: Column) -> DataFrame:
    """(leaf, part, n_rows, n_new, ids_sha256) of each file, from the files: the ids in file order, hashed as they stream by.  `new` is a column of `row`."""
    kind = "leaf string, part int, n_rows long, n_new long, ids_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha, count, fresh = None, hashlib.sha256(), 0, 0
        done: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            leaves, parts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            ids, news = batch.column(2).to_pylist(), batch.column(3).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((leaves[1:] != leaves[:-1]) | (parts[1:] != parts[:-1])) + 1).tolist(), len(ids)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if (leaves[a], parts[a]) != last:
                    if last:
                        done.append((*last, count, fresh, sha.hexdigest()))
                    last, sha, count, fresh = (leaves[a], parts[a]), hashlib.sha256(), 0, 0
                sha.update((("," if count else "") + ",".join(ids[a:b])).encode())
                count, fresh = count + b - a, fresh + int(news[a:b].sum())
        if last:
            done.append((*last, count, fresh, sha.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], ["leaf", "part", "n_rows", "n_new", "ids_sha256"])

    stored = layout.read(spark, schema)
    rows = stored.select("leaf", "part", F.coalesce(F.col("row").getField(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(new, F.lit(False)).alias("new"), "index")
    ordered = rows.repartition(partitions(spark), "leaf", "part").sortWithinPartitions("leaf", "part", "index").drop("index")
    return ordered.mapInArrow(run, kind)


def digest(layout: Layout, spark: SparkSession, schema: StructType, stayed: DataFrame, id_col: str, new: Column) -> DataFrame:
    """A row for each file that is there, read back from the files; stayed is what rewrite() returned."""
    columns = ",".join(layout.columns(spark, schema)) if not stayed.isEmpty() or not layout.files(spark, schema).isEmpty() else ""
    files = layout.files(spark, schema).join(stayed.select("file", F.lit(True).alias("stayed")), "file", "left")
    found = file_digests(layout, spark, schema, id_col, new).join(files, ["leaf", "part"])
    return found.select("leaf", "part", "n_rows", "n_new", F.lit(columns).alias("columns"), "ids_sha256", F.col("file").alias("path"), F.col("stayed").isNull().alias("rewritten"))
