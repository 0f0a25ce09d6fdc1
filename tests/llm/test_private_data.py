import hashlib
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import boosting
from quire.llm import private_data as P

from .common import SCHEMA, documents

BASE = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def valid(kind, span):
    digits = [int(c) for c in span if c in "0123456789"]
    if kind == 1:
        return all(int(p) <= 255 for p in span.split("."))
    if kind == 2:
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == 0 or 9 <= len(digits) <= 15


def brute(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(BASE) for m in re.finditer(p, text or "") if valid(k, m.group()))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a@b.c", "@", "x", ".", "@b.c", "1.2.3.4", "256.1.1.1", "0007.1.1.01", "4111111111111111", "4111 1111-1111 1111", "0" * 12, "+1 (555) 123-4567", "+", "5", " ", "-", "(", "é", "%_", "99"]), max_size=25))
def test_base_spans(pieces):
    text = "".join(pieces)
    assert P.base_spans(text) == brute(text)


def test_time_is_linear():
    for unit in ("x", "1", "1.", "a.", "@", "a@", "+1", "1 ", ":1", "(1", " at "):
        text = unit * (400_000 // len(unit))
        began = time.process_time()
        P.base_spans(text)
        P.proposals(text)
        assert time.process_time() - began < 20, unit


def test_trees():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(int)
    model = boosting.fit(x[:2000], y[:2000])
    assert ((model.scores(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
    again = boosting.fit(x[:2000][::-1], y[:2000][::-1])
    assert np.array_equal(again.scores(x), model.scores(x))
    assert boosting.fit(np.zeros((0, 3)), np.zeros(0)).scores(np.zeros((2, 3))).max() < 0.5
    # Trees of the plain kind, read node by node.
    want = []
    for row in x[:50]:
        total = model.base
        for f, c, v in zip(model.feature, model.cut, model.value, strict=True):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + int(row[f[k]] > c[k])
            total += v[k - len(f)]
        want.append(total)
    assert np.allclose(want, model.margins(x[:50]))


def test_threshold():
    assert P.threshold(np.array([0.9, 0.8, 0.7, 0.6]), np.array([1, 1, 1, 0])) == 0.7
    assert P.threshold(np.array([0.9, 0.9]), np.array([1, 0])) == 2.0 and P.threshold(np.zeros(0), np.zeros(0)) == 2.0


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(4), []
    for d, t in documents(41, 260):
        if t and rng.random() < 0.3:
            words = t.split(" ")
            words.insert(rng.randrange(len(words) + 1), rng.choice(["ann.02@mail.example.com", "10.20.30.40", "4111 1111 1111 1111", "+1 (555) 555-0123", "300.1.1.1", "4111111111111112"]))
            t = " ".join(words)
        out.append((d, t))
    return out


@pytest.fixture(scope="module")
def model(spark, rows):
    return P.fit(spark.createDataFrame(rows, SCHEMA))


def test_query_matches_brute_force(spark, rows, model):
    results = set()
    for parts in (1, 4):
        df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        assert P.fit(df).thresholds == model.thresholds
        got = P.digest(P.find_private(df, model)).collect()
        results.add(tuple(sorted(map(tuple, got), key=str)))
    assert len(results) == 1
    want = []
    for d, t in rows:
        spans = brute(t)
        text = ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        want.append((d, *(sum(k == kind for _, k, _ in spans) for kind in range(4)), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    for r in got:  # base spans stay, whatever is added
        assert r.n_email + r.n_ip + r.n_card + r.n_phone <= len([s for s in r.spans.split(",") if s])


def test_added_spans(model):
    """Forms that no base pattern matches are found, and what looks alike is left alone."""
    rng = random.Random(77)
    found = total = wrong = 0
    for k in range(400):
        kind = k % 4
        span = P.written(rng, kind)
        text = f"the of zebra {span} québec and no"
        if not brute(text):
            total += 1
            found += any(P.KINDS[s[1]] == P.KINDS[kind] and text[s[0] : s[2]] == span for s in model.spans(text))
        other = f"the of zebra {P.decoy(rng)} québec and no"
        wrong += any(not s[3] for s in model.spans(other))
    assert total > 150 and found > 0.85 * total and wrong < 12, (found, total, wrong)


def test_redaction_long_texts_and_clashing_columns(spark, model):
    long_text = "lorem ipsum " * 100_000 + "a@b.cd x +1 (555) 555-0123"
    df = spark.createDataFrame([(1, long_text, "s", 1), (2, None, None, None), (2, "4111 1111 1111 1111.", "s", 0), (None, "", "s", 0)], "doc_id long, text string, spans string, start long")
    got = P.redact(df, model)
    assert got.columns == df.columns
    ends = sorted(r.text[-18:] for r in got.collect())
    assert ends == ["", "", " [EMAIL] x [PHONE]", "[CARD]."]
    assert P.find_private(df, model).count() == 4 and P.find_private(df.limit(0), P.fit(df.limit(0))).collect() == []
