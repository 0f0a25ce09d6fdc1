import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quire.llm.token_counts import count_tokens, ids_of, tags_of, write_flat_files
from quire.llm.token_files import Segment, pack_ids, read_token_files, segment_bytes, unpack_ids, width_of, write_token_files
from quire.llm.tokens import Encoder

from .common import ODD, SCHEMA, documents, texts

NAME = "word_bpe_49k.json"
PATH = public_tokenizers.path(NAME)


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_librarys(plain):
    code = Encoder(PATH)
    assert not code.whole
    some = [*ODD, *texts(3, 200), "Àéî ÿ×÷ ß", "a\x00b \x7f\x01", "x<|y", "0x1F 3.14 a1b2", "it's we'll"]
    ids, at = code.column(pa.array(some, pa.string()))
    for k, text in enumerate(some):
        assert ids[at[k] : at[k + 1]].tolist() == plain.encode(text or "", add_special_tokens=False).ids, text


@pytest.mark.parametrize("width", [1, 5, 8, 13, 16, 17, 31, 32])
def test_bits_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 2**width, 1001, dtype=np.uint64).astype(np.uint32)
    assert unpack_ids(pack_ids(ids, width), len(ids), width).tolist() == ids.tolist()
    assert width_of(2**width) == width


def test_random_access():
    ids = np.arange(200_000, dtype=np.uint32) % 49_408
    raw = segment_bytes(np.array([7, 9, 11]), np.array([1, 1, 0]), np.array([5, 0, 199_995]), ids, 17, 3, 4)
    s = Segment(raw)
    assert (s.n_docs, s.part, s.number) == (3, 3, 4)
    assert s.ids(131_000, 131_100).tolist() == ids[131_000:131_100].tolist()
    assert s.document(0).tolist() == [0, 1, 2, 3, 4] and s.document(1).tolist() == [] and len(s.document(2)) == 199_995


def brute(rows, plain, end):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    out, start = [], 0
    for doc, text in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=str)


@pytest.mark.parametrize("segment", [1 << 22, 50])
def test_files_round_trip(spark, plain, segment):
    rows = documents(5, 80)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    path = write_token_files(df, NAME, 49_408, 1, segment_ids=segment)
    got = sorted(map(tuple, read_token_files(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=str)
    assert got == brute(rows, plain, 1)
    ids = {r.doc_id: r.ids for r in read_token_files(spark, path, with_ids=True).collect()}
    assert ids[4] == plain.encode(rows[2][1], add_special_tokens=False).ids + [1]


def test_empty_table_of_files(spark):
    path = write_token_files(spark.createDataFrame([], SCHEMA), NAME, 49_408, 1)
    assert read_token_files(spark, path).collect() == []


def test_tags():
    ids = np.array([0, 1, -7, 2**62, -(2**63), 2**63 - 1])
    got, known = ids_of(tags_of(ids, np.array([True] * 5 + [False])))
    assert got[:5].tolist() == ids[:5].tolist() and known.tolist() == [True] * 5 + [False]


@pytest.mark.parametrize("block", [1 << 20, 37, 3])
def test_separator_scan(spark, plain, block):
    rows = documents(6, 60)
    path = write_flat_files(spark.createDataFrame(rows, SCHEMA).repartition(4), NAME)
    got = count_tokens(spark, path, block_ids=block).collect()
    want = sorted(((d, len(plain.encode(t or "", add_special_tokens=False).ids)) for d, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == want
    start = 0
    for n, r in enumerate(sorted(got, key=lambda r: r.ordinal)):
        assert (r.ordinal, r.start) == (n, start)
        start += r.n_tokens


def test_separator_scan_over_files(spark, tmp_path):
    flat = np.array([5, 6, 0, 7, 8, 9, 0, 0, 1], "<u2")
    for n, (a, b) in enumerate([(0, 2), (2, 4), (4, 5), (5, 9)]):
        flat[a:b].tofile(tmp_path / f"part-{n}")
    got = sorted((r.ordinal, r.start, r.n_tokens) for r in count_tokens(spark, str(tmp_path), tagged=False, block_ids=2).collect())
    assert got == [(0, 0, 2), (1, 2, 3), (2, 5, 0)]
