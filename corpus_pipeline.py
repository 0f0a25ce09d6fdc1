"""The corpus pipeline: documents without toxic ones, near-duplicates, repeated passages and benchmark passages, packed into sequences.

Each stage takes the session, the documents that its predecessor left and the folder of the tables, and returns a DataFrame;
run() writes it as Parquet to the shared folder and reads it again for the next stage.  All stages but the last return the columns of
documents.

In every stage a null text is an empty one, rows without a doc_id are judged by their text like any other and stay unless it
decides against them, and of an empty table an empty one is left.  Repeated rows are judged each; only the near-duplicate stage makes one
of them.  Extra columns pass through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm.decontaminate import drop_contaminated
from quire.llm.packing import pack
from quire.llm.queries import TOKENIZER
from quire.llm.simhash import drop_near_copies
from quire.llm.storage import fresh_path
from quire.llm.suffix_dedup import replace_texts
from quire.llm.toxicity import drop_toxic, fit


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, fitted on the labels, does not reject."""
    return drop_toxic(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def simhash_near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard of 0.8 or more): the one with the smallest doc_id."""
    return drop_near_copies(docs, width=5, tenths=8)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 50 bytes or more that a document with a smaller doc_id has too."""
    return replace_texts(docs, threshold=50)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of the benchmark."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in the sequences."""
    return pack(docs, TOKENIZER, end_id=0, capacity=2048)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [(f.__name__, f) for f in (toxicity, simhash_near_dup, suffix_array_dedup, decontamination, best_fit_packing)]

#: Fingerprints, components, suffixes and packing have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
