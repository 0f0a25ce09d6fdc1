import math
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quire.operators import search as R

PAGES = [
    ("150", 10, "texto", "Canta, oh diosa, la cólera del Pélida Aquiles, cólera funesta que causó males a los griegos.", ""),
    ("150", 11, "texto", "El hijo de Peleo respondió a los griegos reunidos junto a las naves.", "1 Hefesto forjó sus armas."),
    ("150", 12, "texto", "Aquiles", ""),
    ("150", 13, "notas_finales", "Nota sobre los griegos y Troya.", ""),
    ("2", 5, "introduccion", "Los griegos de Esparta se llamaban lacedemonios.", ""),
    ("2", 90, "indice_nombres", "", "Lacedemonios, 12, 45"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    pages = spark.createDataFrame([(*p, "a", "o", "") for p in PAGES], "canonico string, hoja int, seccion string, cuerpo string, notas string, autor string, obra string, titulo string")
    rows = R.passages(pages, ["canonico", "hoja", "autor", "obra", "titulo"])
    rows = rows.withColumn("id", F.xxhash64("canonico", "hoja", "clase", "orden") % 1_000_000).cache()
    return R.Index.build(rows), rows


def find(corpus, query, **more):
    decided, rows = R.search(*corpus, query, **more)
    return decided, [(r.canonico, r.hoja, r.clase) for r in rows.collect()]


def test_chunks_share_forty_words(spark):
    text = " ".join(f"w{i}" for i in range(400))
    got = spark.createDataFrame([(text,)], "t string").select(R.chunks(F.col("t"))).collect()[0][0]
    assert [len(c.split()) for c in got] == [180, 180, 120]
    assert got[0].split()[-40:] == got[1].split()[:40]
    again = spark.createDataFrame([(got,)], "p array<string>").select(R.rejoin(F.col("p"))).collect()[0][0]
    assert again == text


@pytest.mark.parametrize("n", [0, 1, 179, 180, 181, 320, 321, 700])
def test_chunk_rule(spark, n):
    words = [f"p{i}" + (" " if i % 7 else "\n\xa0") for i in range(n)]
    text = "".join(words)
    want = []
    if n:
        for a in range(0, n, 140):
            want.append("".join(words[a : a + 180]).strip())
            if a + 180 >= n:
                break
    assert spark.createDataFrame([(text,)], "t string").select(R.chunks(F.col("t"))).collect()[0][0] == want


def test_classes_and_scopes(corpus):
    rows = {(r.canonico, r.hoja, r.clase) for r in corpus[1].collect()}
    assert ("150", 11, "notas") in rows and ("2", 90, "aparato") in rows and ("2", 5, "editor") in rows
    assert find(corpus, "Hefesto")[1] == [("150", 11, "notas")] and find(corpus, "Hefesto", classes=R.SCOPES[2])[1] == []
    assert find(corpus, "mirmidones")[1] == []


def test_relaxation(corpus):
    decided, rows = find(corpus, "trirreme Aquiles")
    assert (decided.mode, decided.words) == ("algunas", ["Aquiles"]) and ("150", 10, "obra") in rows
    assert find(corpus, "cólera Aquiles")[0].mode == "todas"
    assert find(corpus, "")[0].mode == "vacia" and find(corpus, "de los")[0].mode == "solo_vacias"
    decided, rows = find(corpus, "griegos Hefesto Esparta")
    assert decided.mode == "algunas" and rows


def test_facets(corpus):
    _, facet = R.volume_facet(*corpus, "griegos")
    assert {r.canonico: (r.pasajes, r.hojas) for r in facet.collect()} == {"150": (3, 3), "2": (1, 1)}
    _, by_class = R.class_facet(*corpus, "griegos")
    assert {r.clase: r.tomos for r in by_class.collect()} == {"obra": 1, "notas": 1, "editor": 1}


def test_scores(corpus):
    index, rows = corpus
    docs = {r.id: re.findall(r"[^\W_]+", R.fold_words(r.texto)) for r in rows.collect()}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    want = {}
    for i, words in docs.items():
        s = 0
        for t in ("griegos", "los"):
            df, tf = sum(t in w for w in docs.values()), words.count(t)
            s += max(1e-6, math.log((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
        if "griegos" in words and "los" in words:
            want[i] = -s
    decided, hits = R.plan(index, '"los" griegos')
    got = {r.id: r.bm for r in R.rank(index, decided, hits).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i]) for i in want)


def test_phrases_and_prefixes(corpus):
    assert find(corpus, '"a los griegos"')[1] and not find(corpus, '"griegos los"')[1]
    assert {r[0] for r in find(corpus, "lacede*")[1]} == {"2"}


@pytest.mark.parametrize(
    ("query", "words"),
    [("el alma es inmortal", ["alma", "inmortal"]), ("de los", ["de", "los"]), ("¿qué tomo habla de los lacedemonios?", ["lacedemonios"]), ("el libro de los muertos", ["libro", "muertos"]), ('"el alma" x:y', ["el alma", "x y"]), ("nómos", ["nómos"]), ("a* lac*", ["lac"])],
)
def test_pieces(query, words):
    assert [p.text for p in R.pieces(query)] == words


def test_names(spark):
    volumes = spark.createDataFrame([("v", {"Aquiles": ["1", " 2 "], "y ss": ["1"], "XV I": ["2"], "Pa": ["1"], "Áyax, rey": ["3"]})], "canonico string, indice_nombres map<string, array<string>>")
    names = R.load_names(volumes, ["canonico"])
    assert sorted((r.nombre, r.normal, r.refs, r.cuantas) for r in names.collect()) == [("Aquiles", "aquiles", "1; 2", 2), ("Áyax, rey", "ayax, rey", "3", 1)]
    assert [r.nombre for r in R.find_names(names, "AYAX").collect()] == ["Áyax, rey"]
    assert [r.nombre for r in R.suggest_names(names, "aq").collect()] == ["Aquiles"] and R.suggest_names(names, "a").count() == 0
    rows = spark.createDataFrame([(1, "v", "Aquiles y ayax, y otra vez Aquiles")], "id int, canonico string, texto string")
    assert R.names_in_passages(rows, names).collect()[0].nombres == ["Aquiles", "Áyax"]


def test_preliminaries(spark):
    def pages(spec):
        return spark.createDataFrame([("v", i, "texto", "", t, ["1"] if m else []) for i, (t, m) in enumerate(spec)], "canonico string, pdf int, seccion string, obra string, titulo string, versos array<string>")

    got = lambda spec: {r.pdf for r in R.preliminaries(pages(spec)).collect()}
    body = [("", True)] * 6
    assert got([("Sinopsis", False), ("3. Nuestra edición", False), ("Acto", False), *body]) == {0, 1}
    assert got([("1. Vida", False), ("2. Obra", False), ("3.1. Fama", False), ("Acto", False), *body]) == {0, 1, 2}
    assert got([("Sinopsis", False)] * 4) == set() and got(body) == set()


def test_page_of_the_day(corpus, spark):
    index, rows = corpus
    table = rows.withColumn("nombres", F.lit(0)).withColumn("hojas", F.lit(0))
    names = spark.createDataFrame([("150", "Peleo", "peleo", "1", 1)], "canonico string, nombre string, normal string, refs string, cuantas int")
    day = R.passage_of_the_day(table, names, "2026-08-08").collect()
    assert len(day) == 1 and day[0].hoja == 11 and day == R.passage_of_the_day(table, names, "2026-08-08").collect()


def test_stored_index_answers_alike(corpus, tmp_path):
    index, rows = corpus
    stored = R.Index.write(rows, str(tmp_path / "index"), parts=4)
    assert (stored.passages, stored.words) == (index.passages, index.words)
    for query in ("griegos los", '"a los griegos"', "lacede* griegos", "trirreme Aquiles", "los", "griegos zzz"):
        assert find((stored, rows), query) == find(corpus, query)


def test_best_equals_scoring_all(spark, tmp_path, monkeypatch):
    """Bounds skip shards and lose no row; ties stay in order of their ids."""
    rng = random.Random(3)
    monkeypatch.setattr(R, "SHARD", 40)
    monkeypatch.setattr(R, "SEEDS", 3)
    texts = []
    for i in range(2000):
        words = [rng.choice(["mar", "sol", "luz", "pan"]) for _ in range(rng.randint(0, 3))] + ["rel"] * rng.randint(20, 60)
        if i // 40 in (7, 19, 33):
            words += ["mar"] * rng.randint(1, 6) + ["sol"] * rng.randint(1, 6)
        texts.append((i, " ".join(words)))
    rows = spark.createDataFrame(texts, "id long, texto string").withColumn("busqueda", F.lit(None).cast("string")).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        index = R.Index.write(rows, str(tmp_path / "index"), parts=4)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plain = R.Index.build(rows)
    for query in ("mar sol", "mar", "sol luz pan"):
        for limit in (10, 60):
            decided, got = R.best(index, query, rows.select("id"), limit)
            planned, hits = R.plan(plain, query)
            want = R.rank(plain, planned, hits).orderBy("bm", "id").limit(limit).collect()
            assert [(r.id, round(r.bm, 9)) for r in got.collect()] == [(r.id, round(r.bm, 9)) for r in want]
            assert (decided.mode, decided.frequency) == (planned.mode, planned.frequency)
            if query == "mar sol" and limit == 10:
                assert decided.shards[1] < decided.shards[0] / 4
    assert R.best(index, "mar zzz", rows.select("id"), 5) is None and R.best(index, '"mar sol"', rows.select("id"), 5) is None and R.best(plain, "mar", rows.select("id"), 5) is None


def test_names_by_automaton_match_a_plain_search(spark, monkeypatch):
    """Nested names, names of other volumes, and a volume that is divided."""
    monkeypatch.setattr(R, "PASSAGES_A_TASK", 9)
    rng = random.Random(2)
    stock = ["ana bel", "ana belen", "belen", "mar rojo", "rojo", "rojos", "sol"]
    names = [(v, n.title() + rng.choice(["", ", el viejo"]), n) for v in "ab" for n in rng.sample(stock, 6)]
    rows = [(i, rng.choice("abc"), " ".join(rng.choice([*stock, "x"]) for _ in range(rng.randint(0, 6)))) for i in range(120)]
    got = R.names_in_passages(spark.createDataFrame(rows, "id long, canonico string, texto string"), spark.createDataFrame(names, "canonico string, nombre string, normal string"), 3)
    want = {}
    for i, v, t in rows:
        found = sorted({(-t.count(n), -len(name.split(",")[0]), name.split(",")[0], n) for w, name, n in names if w == v and len(n) >= 4 and n in t})
        kept = []
        for _, _, name, n in found:
            if not any(n in o for _, o in kept):
                kept.append((name, n))
        if kept:
            want[i] = [name for name, _ in kept[:3]]
    assert {r.id: r.nombres for r in got.collect()} == want


def test_a_prefix_reads_one_part(corpus, spark, tmp_path):
    index = R.Index.write(corpus[1], str(tmp_path / "index"), parts=8)
    for terms, prefixes, most in ((["griegos"], [], 1), ([], ["lace"], 1), (["los"], ["gri"], 2)):
        plan = index.find(terms, prefixes)._jdf.queryExecution().executedPlan().toString()
        asked = re.search(r"part#\d+ (?:IN \(([\d,]+)\)|= (\d))", plan)
        assert len((asked[1] or asked[2]).split(",")) <= most


def test_completions(spark, tmp_path):
    rng = random.Random(6)
    names = [("".join(rng.choice("ab ñ") for _ in range(rng.randint(1, 16))), rng.randint(1, 4)) for _ in range(400)]
    rows = spark.createDataFrame([(n.title(), n, k) for n, k in names], "nombre string, normal string, cuantas int")
    R.store_completions(rows, str(tmp_path / "c"), parts=4)
    stored = spark.read.parquet(str(tmp_path / "c"))
    for prefix in ("ab", "b", "aab", "abababababab", "zz"):
        assert R.complete(stored, prefix, parts=4).collect() == R.suggest_names(rows, prefix).collect(), prefix
    assert R.complete(stored, "a" * 13, parts=4) is None


SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SMALL).exists(), reason="the driver's tables aren't here")
def test_every_sheet_is_recomposed_with_its_words(spark):
    from quire.plans.search_queries import QUERIES

    texts = {r.doc_id: (r.text or "").split() for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id is not null").collect()}
    got = {r.hoja: (r.cuerpo.split(), r.notas.split()) for r in QUERIES["page_recompose"](spark, SMALL).collect()}
    assert got == {d: ([], w) if d % 8 == 3 else (w, []) for d, w in texts.items() if w}


def test_text_that_repeats_itself_keeps_its_words():
    words = ["a"] * 320
    assert R.rejoin_parts([" ".join(words[:180]), " ".join(words[140:])]).split() == words
