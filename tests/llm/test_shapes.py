"""Very long texts, columns with names that the operators use themselves, and the queries' SQL."""

import os
import random
import zlib
from pathlib import Path

import duckdb
import pytest
from tokenizers import Tokenizer

from quire.llm.chat_format import digest as chat_digest
from quire.llm.chat_format import format_chat, text_parts
from quire.llm.lm_score import score_documents
from quire.llm.packing import pack
from quire.llm.queries import ORACLE_SQL, QUERIES
from quire.llm.simhash import keep_one, near_duplicates
from quire.llm.suffix_dedup import digest, replace_texts, suffix_dedup
from quire.llm.token_counts import count_tokens, write_flat_files
from quire.llm.token_files import read_token_files, write_token_files

from .test_simhash import fingerprint
from .test_tokens import NAME, PATH

FOLDER = os.environ.get("QUIRE_TABLES", "/root/testdata/sf0.001")
CLASHING = "doc_id long, text string, id string, block long, node long, bucket int, text_ string, start long, length int, part int, print string, __key string"


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(8)
    return " ".join(f"{rng.choice(['ab', 'cd', 'éf'])}{i % 9973}x{i}" for i in range(330_000))


def test_texts_beyond_a_block(spark, long_text):
    assert len(long_text.encode()) > 4 << 20
    rows = [(1, long_text), (2, "zz " + long_text[100:]), (3, "short"), (4, None)]
    got = {r.doc_id: r for r in digest(suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), threshold=50)).collect()}
    gone = len(long_text[100:].encode())
    assert (got[1].n_removed, got[3].n_removed, got[4].n_bytes) == (0, 0, 0)
    assert got[2].n_spans == 1 and gone <= got[2].n_removed <= gone + 3 and got[2].n_bytes == gone + 3
    scored = {r.doc_id: r for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert scored[1].n_words == 330_000 and abs(scored[2].n_words - 330_000) < 20 and scored[4].mean_log_score is None
    prints = {r.doc_id: r.fingerprint for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert prints[1] == f"{fingerprint(long_text):016x}" and prints[4] == "0" * 16


def test_long_texts_are_encoded_whole(spark, long_text):
    text = long_text[: 1_500_000]
    ids = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    rows = [(7, text), (3, "a b"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in read_token_files(spark, write_token_files(df, NAME, 49_408, end_id=1, segment_ids=10_000)).collect()}
    raw = b"".join(i.to_bytes(4, "little") for i in [*ids, 1])
    assert (got[7].n_tokens, got[7].ids_crc32) == (len(ids) + 1, zlib.crc32(raw)) and got[None].start == 0 and got[7].start == got[3].start + got[3].n_tokens
    counted = {r.doc_id: r.n_tokens for r in count_tokens(spark, write_flat_files(df, NAME)).collect()}
    assert counted[7] in (len(ids), len(ids) + 1)
    pieces = [r for r in pack(df, NAME, end_id=0, capacity=2048).collect() if r.doc_id == 7]
    assert sum(r.length for r in pieces) == len(ids) + 1 and max(r.length for r in pieces) == 2048


def test_clashing_columns(spark):
    rows = [(i, t, "x", 1, 2, 3, "y", 4, 5, 6, "z", "k") for i, t in enumerate(["one two three", "one two three", None, "", "four five six " * 30])]
    df = spark.createDataFrame(rows, CLASHING)
    assert read_token_files(spark, write_token_files(df, NAME, 49_408, end_id=1)).count() == 5
    assert count_tokens(spark, write_flat_files(df, NAME)).count() == 5
    assert pack(df, NAME, end_id=0, capacity=2048).count() == 5
    assert sorted(r.n_words for r in score_documents(df).collect()) == [0, 0, 3, 3, 90]
    assert suffix_dedup(df).count() == 5 and replace_texts(df).columns == df.columns and replace_texts(df).count() == 5
    kept = keep_one(df, near_duplicates(df))
    assert kept.columns == df.columns and kept.count() == 3
    turns = df.select(df.doc_id.alias("conv_id"), df.block.alias("turn"), df.text_.alias("role"), df.text, df.start, df.length, df.id.alias("loss"), df.id.alias("place"), df.id.alias("media"))
    formatted = format_chat(turns.withColumn("parts", text_parts(turns.text)))
    assert chat_digest(formatted).count() == 5


@pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="the driver's tables aren't there")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for file in sorted(Path(FOLDER).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    said = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in said.description]
    found = QUERIES[name](spark, FOLDER)
    assert sorted(names) == sorted(found.columns)
    assert sorted((tuple(r[c] for c in names) for r in found.collect()), key=str) == sorted(said.fetchall(), key=str)
