"""Filters by a part of a text (LIKE '%...%' without wildcards) over stored trigrams.

A text's trigrams, each once, are rows (campo, trigrama, id), dealt to parts by the trigram.  A text that contains a pattern has all trigrams of it, so a filter reads the parts of
the pattern's trigrams, keeps the ids that have all of them, and verifies these by `contains`: the rows are those of a sweep over the table.  Patterns of
one or two characters are a sweep.

Texts are compared as `fold` gives them (lower case, without accents), so a folded pattern is looked for.  Null texts contain nothing; an empty pattern is in every
other text.  Ids must be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import fold, fold_words, let

LENGTH, ROWS_A_FILE = 3, 20_000_000


def trigrams(text: Column) -> Column:
    """Each run of three characters of a text, once."""
    return let(fold(text), lambda t: F.when(F.length(t) >= LENGTH, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - (LENGTH - 1)), lambda i: F.substring(t, i, F.lit(LENGTH))))).otherwise(F.array().cast("array<string>")))


def _part(gram: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(parts)).cast("int")


class Trigrams:
    """Stored trigrams of some columns of a table."""

    def __init__(self, spark: SparkSession, path: str, parts: int = 64) -> None:
        self.spark, self.path, self.parts = spark, path, parts

    def write(self, table: DataFrame, columns: list[str], id_col: str = "id") -> Trigrams:
        """A part may be several files, by a hash of the id: a trigram that most texts have isn't one task's work."""
        fields = F.explode(F.array(*[F.struct(F.lit(c).alias("campo"), trigrams(F.col(c)).alias("g")) for c in columns]))
        rows = table.select(F.col(id_col).alias("id"), fields.alias("f")).select(F.col("f.campo").alias("campo"), F.explode("f.g").alias("trigrama"), "id").withColumn("part", _part(F.col("trigrama"), self.parts))
        files = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-table.count() // ROWS_A_FILE))))
        rows.repartition("part", files).sortWithinPartitions("part", "campo", "trigrama", "id").write.partitionBy("part").mode("overwrite").parquet(self.path)
        return self

    def candidates(self, column: str, pattern: str) -> DataFrame | None:
        """(id) of the texts that have all trigrams of a pattern; None for patterns without one."""
        plain = fold_words(pattern)
        own = sorted({plain[i : i + LENGTH] for i in range(len(plain) - LENGTH + 1)})
        if not own:
            return None
        rows = self.spark.read.parquet(self.path).where((F.col("campo") == column) & F.col("trigrama").isin(own) & F.col("part").isin(*[_part(F.lit(g), self.parts) for g in own]))
        if len(own) == 1:
            return rows.select("id")
        return rows.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(own)).select("id")

    def filter(self, table: DataFrame, column: str, pattern: str, id_col: str = "id") -> DataFrame:
        """The rows of table whose column contains the pattern."""
        found = self.candidates(column, pattern)
        rows = table if found is None else table.join(found.withColumnRenamed("id", "__id"), F.col(id_col) == F.col("__id"), "left_semi")
        return rows.where(F.contains(fold(F.col(column)), F.lit(fold_words(pattern))))
