import corpus_pipeline
import pytest

from quire.llm.toxicity import drop_toxic, fit

from .common import texts
from .test_decontaminate import brute as contaminated
from .test_near_copies import brute as near
from .test_packing import check

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def kept_chars(rows, threshold=50):
    """Texts without the whole characters that repeated windows cover."""
    first = {}
    for d, t in rows:
        raw = t.encode()
        for i in range(len(raw) - threshold + 1):
            w = raw[i : i + threshold]
            first[w] = min(d, first.get(w, d))
    out = []
    for d, t in rows:
        raw = t.encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - threshold + 1):
            if first[raw[i : i + threshold]] < d:
                gone[i : i + threshold] = [True] * threshold
        at, keep = 0, []
        for c in t:
            n = len(c.encode())
            if not all(gone[at : at + n]):
                keep.append(c)
            at += n
        out.append((d, "".join(keep)))
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    bench = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [(i, t + (" you idiot you stupid moron" if i % 7 == 0 else "") + (f" {bench} tail" if i % 11 == 0 else ""), "en", "s", len(t)) for i, t in enumerate(texts(21, 140))]
    rows += [(900, None, "en", "s", None), (901, "", None, None, 0)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i % 7 == 0)) for i in range(0, 140, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, [(1, bench)]


def test_run_matches_brute_force(spark, tables):
    path, rows, items = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    grammar = fit(docs, spark.read.parquet(f"{path}/labels.parquet"))
    clean = [(d, t or "") for d, t, *_ in rows if grammar.score(grammar.matches(t or "")) < 0.5]
    assert sorted(r.doc_id for r in drop_toxic(docs, grammar).collect()) == sorted(d for d, _ in clean)
    once, pairs = near(clean)
    kept = kept_chars(sorted(once))
    hit = {r[0] for r in contaminated(kept, items, 10) if r[5]}
    left = [(d, t) for d, t in kept if d not in hit]
    assert pairs and 10 < len(left) < len(kept) < len(clean) < len(rows)
    check(left, corpus_pipeline.run(spark, path).collect(), 2048)


def test_stages_lose_no_row_to_shared_ids(spark, tables):
    path, *_ = tables
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(3, b, "en", "s", 1), (5, a, "en", "s", 2), (5, b, "en", "s", 3), (None, None, None, None, None), (7, "", None, None, 0)]
    want = {"toxicity": 5, "simhash_near_dup": 4, "suffix_array_dedup": 5, "decontamination": 5}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for parts in (1, 3):
            docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
            assert stage(spark, docs, path).count() == want[name], name
    kept = corpus_pipeline.simhash_near_dup(spark, spark.createDataFrame(rows, SCHEMA), path).collect()
    assert sorted((r.doc_id, r.text[:2]) for r in kept if r.text) == [(3, "b0"), (5, "a0")]


def test_stages_return_the_columns_of_documents(spark, tables):
    path, *_ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(20)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dup", "suffix_array_dedup", "decontamination", "best_fit_packing"]


def test_stages_on_an_empty_table_and_repeated_rows(spark, tables):
    path, *_ = tables
    none = spark.createDataFrame([], SCHEMA)
    again = spark.createDataFrame([(1, "x" * 80, "en", "s", 80)] * 3 + [(None, "x" * 80, "en", "s", 80)], SCHEMA)
    # Near copies are one row, beside those without an id; the other stages judge each row.
    want = {"toxicity": 4, "simhash_near_dup": 2, "suffix_array_dedup": 4, "decontamination": 4, "best_fit_packing": 4}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, path).collect() == []
        assert stage(spark, again, path).count() == want[name], name
