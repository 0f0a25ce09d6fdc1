import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm.fill_middle import cuts, digest, fill_in_middle, place_of, token_starts

from .common import SCHEMA, documents

TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]", re.DOTALL)


def brute(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    draw = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(draw[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(tokens), "plain", text, None, None
    form = "spm" if h[3] % 100 < 20 else "psm"
    return doc_id, len(tokens), form, f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}", len(p), len(m)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aZb é\n0🙂ſªK[`@{")), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_cuts(text, first, second):
    tokens = TOKEN.findall(text)
    a, b = sorted((first % (len(tokens) + 1), second % (len(tokens) + 1)))
    assert cuts(text, first, second) == (len(tokens), len("".join(tokens[:a])), len("".join(tokens[:b])))


def test_every_start_is_found():
    rng = random.Random(3)
    text = "".join(rng.choice("ab  ñ,") for _ in range(700))
    bits, width = token_starts(text)
    starts = [m.start() for m in TOKEN.finditer(text)]
    assert [place_of(bits, width, k) for k in range(len(starts) + 1)] == [*starts, len(text)]
    assert token_starts("") == (0, 0) and place_of(0, 0, 0) == 0


@pytest.fixture(scope="module")
def rows():
    marked = [(20_000, "a <P> b"), (20_001, "x<S>y"), (20_002, "<M>"), (20_003, "<P <S> "), (20_004, "< P>"), (20_005, "<P>" * 50)]
    return documents(31, 300) + marked + [(30_000 + i, "<" * i + "S P>M>" + "é🙂 b" * i) for i in range(60)]


def test_matches_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = fill_in_middle(df)
    got = [tuple(r[c] for c in ("doc_id", "n", "form", "output", "prefix_chars", "middle_chars")) for r in found.collect()]
    want = [brute(*row) for row in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(((r.doc_id, r.output_sha256, r.restored_sha256) for r in digest(found).collect()), key=str) == sorted(((d, sha(w[3]), sha(t or "")) for (d, t), w in zip(rows, want, strict=True)), key=str)


def test_shares_long_texts_and_clashing_columns(spark):
    long_text = "word, " * 400_000
    df = spark.createDataFrame([(1, long_text, "x", 1, 2, 3, "y"), (2, None, "x", 1, 2, 3, "y")], "doc_id long, text string, t string, n long, c long, d long, form string")
    got = {r.doc_id: r for r in fill_in_middle(df, plain_percent=0, spm_percent=100).collect()}
    assert (got[1].n, got[1].form, len(got[1].output), got[2].form, got[2].output) == (1_200_000, "spm", len(long_text) + 9, "plain", "")
    assert {r.form for r in fill_in_middle(df, plain_percent=100).collect()} == {"plain"}
    assert fill_in_middle(df.limit(0)).collect() == []
