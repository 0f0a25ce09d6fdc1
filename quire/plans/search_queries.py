"""Queries of retrieval over documents, each with its SQL.

Documents are pages: the source is the volume, doc_id the sheet; class and section follow from doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import ALL_SPACE, SPACE
from quire.operators import search as R
from quire.operators.substring import Trigrams
from quire.plans.store_queries import read
from quire.session import spread, work_path

QUERIES: dict = {}
SQL: dict[str, str] = {}

_SECTIONS = ["texto", "texto", "introduccion", "notas_finales", "bibliografia", "texto", "texto", "indice_nombres"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def pages(spark, sf) -> DataFrame:
    section = F.element_at(F.array(*map(F.lit, _SECTIONS)), (F.col("doc_id") % 8 + 1).cast("int"))
    return read(spark, sf, "documents").where("doc_id is not null").select(F.col("doc_id").alias("hoja"), F.col("source").alias("canonico"), F.col("source").alias("autor"), F.col("lang").alias("obra"), section.alias("seccion"), F.col("text").alias("cuerpo"), F.lit("").alias("notas"))


def table(spark, sf) -> DataFrame:
    rows = R.passages(spread(pages(spark, sf)), ["hoja", "canonico", "autor", "obra"])
    return rows.withColumn("id", F.col("hoja") * 100_000 + F.col("orden"))


_STORED: dict[tuple[str, str], tuple[R.Index, DataFrame]] = {}


def build(spark, sf, path: str) -> tuple[R.Index, DataFrame]:
    """Passages and their index, cut, tokenized and written below path."""
    table(spark, sf).write.parquet(f"{path}/passages")
    rows = spark.read.parquet(f"{path}/passages")
    return R.Index.write(rows, path, parts=16), rows


def stored(spark, sf) -> tuple[R.Index, DataFrame]:
    """The stored index of a session, built by the first query that asks."""
    key = spark.sparkContext.applicationId, sf
    if key not in _STORED:
        _STORED[key] = build(spark, sf, work_path(spark, "search"))
    return _STORED[key]


# One common table expression for all: chunks, tokens, lengths.  White space is the same explicit class in both engines.
_WS = ALL_SPACE[1:-1]
_CLASS = "CASE s WHEN 'texto' THEN 'obra' WHEN 'introduccion' THEN 'editor' WHEN 'notas_finales' THEN 'notas' ELSE 'aparato' END"
_LIST = "[" + ", ".join(f"'{s}'" for s in _SECTIONS) + "]"
CHUNKS = f"""c0 AS (SELECT doc_id, source, lang, {_LIST}[CAST(doc_id % 8 AS INT) + 1] AS s, regexp_replace(coalesce(text, ''), '^[{_WS}]+|[{_WS}]+$', '', 'g') AS t FROM documents WHERE doc_id IS NOT NULL),
c1 AS (SELECT *, regexp_extract_all(t, '[^{_WS}]+[{_WS}]*') AS w FROM c0 WHERE t <> ''),
c2 AS (SELECT *, unnest(range(0, 1 + greatest(0, CAST(ceil((len(w) - 180) / 140.0) AS BIGINT)))) AS i FROM c1),
chunks AS (SELECT doc_id AS hoja, source AS canonico, lang AS obra, s AS seccion, {_CLASS} AS clase, i AS orden, doc_id * 100000 + i AS id,
 CASE WHEN len(w) <= 180 THEN t ELSE regexp_replace(array_to_string(w[i * 140 + 1:i * 140 + 180], ''), '^[{_WS}]+|[{_WS}]+$', '', 'g') END AS texto FROM c2),
toks AS (SELECT id, regexp_extract_all(strip_accents(lower(texto)), '[\\p{{L}}\\p{{N}}]+') AS tk FROM chunks),
dl AS (SELECT id, len(tk) AS dl FROM toks),
st AS (SELECT count(*) AS n, avg(dl) AS av FROM dl)"""


@query(f"WITH {CHUNKS} SELECT hoja, orden, texto, clase, len(regexp_extract_all(texto, '[^{_WS}]+')) AS palabras FROM chunks")
def chunks(spark, sf):
    return table(spark, sf).select("hoja", "orden", "texto", "clase", "palabras")


@query(f"WITH {CHUNKS}, x AS (SELECT id, unnest(tk) AS term FROM toks) SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM x GROUP BY term")
def term_counts(spark, sf):
    return R.postings(table(spark, sf)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _hits(terms: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT {k} AS piece, id, len(list_filter(tk, lambda x: x = '{t}')) AS tf FROM toks WHERE list_contains(tk, '{t}')" for k, t in enumerate(terms))


def _rank(hits: str, used: int) -> str:
    return f"""hits AS ({hits}), df AS (SELECT piece, count(*) AS df FROM hits GROUP BY piece),
ranked AS (SELECT id, -sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / av))) AS bm FROM hits JOIN df USING (piece) JOIN dl USING (id), st
 GROUP BY id HAVING count(*) = {used})"""


_TWO = _rank(_hits(["the", "and"]), 2)
_WEIGHT = "CASE clase WHEN 'obra' THEN 1.0 WHEN 'editor' THEN 0.85 WHEN 'aparato' THEN 0.70 ELSE 0.55 END * CASE seccion WHEN 'texto' THEN 1.0 WHEN 'introduccion' THEN 0.85 WHEN 'notas_finales' THEN 0.55 WHEN 'bibliografia' THEN 0.35 ELSE 0.30 END * CASE WHEN p < 12 THEN 0.40 WHEN p < 30 THEN 0.65 WHEN p < 60 THEN 0.88 ELSE 1.0 END"


@query(f"WITH {CHUNKS} SELECT count(*) AS pasajes, sum(len(tk))::BIGINT AS palabras, sum(len(list_distinct(tk)))::BIGINT AS entradas FROM toks")
def search_index(spark, sf):
    """A whole index built anew: passages, words, and postings."""
    index, _ = build(spark, sf, work_path(spark, "search"))
    entries = index.lists.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("entradas"))
    return entries.select(F.lit(index.passages).cast("long").alias("pasajes"), F.lit(index.words).cast("long").alias("palabras"), "entradas")


@query(f"WITH {CHUNKS}, {_TWO} SELECT id, round(bm, 6) AS bm FROM ranked")
def bm25_scores(spark, sf):
    index, _ = stored(spark, sf)
    decided, hits = R.plan(index, "the and")
    return R.rank(index, decided, hits).select("id", F.round("bm", 6).alias("bm"))


@query(f"WITH {CHUNKS}, {_TWO} SELECT id, round(bm, 6) AS bm FROM ranked ORDER BY ranked.bm, id LIMIT 40")
def bm25_topk(spark, sf):
    index, rows = stored(spark, sf)
    found = R.best(index, "the and", rows.select("id"), 40)
    if found is None:
        decided, hits = R.plan(index, "the and")
        found = decided, R.rank(index, decided, hits).orderBy("bm", "id").limit(40)
    return found[1].select("id", F.round("bm", 6).alias("bm"))


@query(f"""WITH {CHUNKS}, {_TWO}, best AS (SELECT r.id, bm, hoja, canonico, clase, seccion, len(regexp_extract_all(texto, '[^{_WS}]+')) AS p FROM ranked r JOIN chunks USING (id) ORDER BY bm, id LIMIT 400),
w AS (SELECT *, bm * {_WEIGHT} AS peso FROM best), f AS (SELECT *, row_number() OVER (PARTITION BY canonico, hoja, clase ORDER BY peso, bm, id) AS a FROM w),
v AS (SELECT *, row_number() OVER (PARTITION BY canonico ORDER BY peso, bm, id) AS b FROM f WHERE a = 1)
SELECT id, canonico, hoja, clase, round(peso, 6) AS peso FROM v WHERE b <= 3 ORDER BY v.peso, bm, id LIMIT 40""")
def bm25_weighted(spark, sf):
    index, rows = stored(spark, sf)
    _, best = R.search(index, rows, "the and")
    return best.select("id", "canonico", "hoja", "clase", F.round("peso", 6).alias("peso"))


@query(f"""WITH {CHUNKS}, {_TWO}, best AS (SELECT r.id, bm, hoja, canonico, clase, seccion, len(regexp_extract_all(texto, '[^{_WS}]+')) AS p FROM ranked r JOIN chunks USING (id) WHERE contains(lower(canonico), 'src1') AND contains(lower(obra), 'en') AND clase IN ('obra', 'aparato') ORDER BY bm, id LIMIT 400),
w AS (SELECT *, bm * {_WEIGHT} AS peso FROM best), f AS (SELECT *, row_number() OVER (PARTITION BY canonico, hoja, clase ORDER BY peso, bm, id) AS a FROM w)
SELECT id, canonico, hoja, clase, round(peso, 6) AS peso FROM f WHERE a = 1 ORDER BY f.peso, bm, id LIMIT 40""")
def bm25_filtered(spark, sf):
    """The best passages of one author and work, in two classes."""
    index, rows = stored(spark, sf)
    _, best = R.search(index, rows, "the and", classes=R.SCOPES[1], author="SRC1", work="En", per_volume=0)
    return best.select("id", "canonico", "hoja", "clase", F.round("peso", 6).alias("peso"))


@query(f"WITH {CHUNKS}, {_rank(_hits(['of', 'the']), 2)} SELECT 'algunas' AS modo, id, round(bm, 6) AS bm FROM ranked")
def relaxed_query(spark, sf):
    index, _ = stored(spark, sf)
    decided, hits = R.plan(index, "qqqzzz the of")
    return R.rank(index, decided, hits).select(F.lit(decided.mode).alias("modo"), "id", F.round("bm", 6).alias("bm"))


_PHRASE = "SELECT 0 AS piece, id, len(list_filter(range(1, len(tk)), lambda i: tk[i] = 'of' AND tk[i + 1] = 'the')) AS tf FROM toks WHERE len(list_filter(range(1, len(tk)), lambda i: tk[i] = 'of' AND tk[i + 1] = 'the')) > 0"


@query(f"WITH {CHUNKS}, {_rank(_PHRASE, 1)} SELECT id, round(bm, 6) AS bm FROM ranked")
def phrase_query(spark, sf):
    index, _ = stored(spark, sf)
    decided, hits = R.plan(index, '"of the"')
    return R.rank(index, decided, hits).select("id", F.round("bm", 6).alias("bm"))


_PREFIX = "SELECT 0 AS piece, id, len(list_filter(tk, lambda x: starts_with(x, 'thing'))) AS tf FROM toks WHERE len(list_filter(tk, lambda x: starts_with(x, 'thing'))) > 0"


@query(f"WITH {CHUNKS}, {_rank(_PREFIX, 1)} SELECT id, round(bm, 6) AS bm FROM ranked")
def prefix_query(spark, sf):
    index, _ = stored(spark, sf)
    decided, hits = R.plan(index, "thing*")
    return R.rank(index, decided, hits).select("id", F.round("bm", 6).alias("bm"))


@query(f"WITH {CHUNKS}, {_TWO} SELECT canonico, count(*) AS pasajes, count(DISTINCT hoja) AS hojas FROM ranked JOIN chunks USING (id) WHERE clase IN ('obra', 'aparato') GROUP BY canonico")
def volume_hits(spark, sf):
    index, rows = stored(spark, sf)
    return R.volume_facet(index, rows, "the and", R.SCOPES[1])[1]


@query(f"WITH {CHUNKS}, {_TWO} SELECT clase, count(DISTINCT canonico) AS tomos, count(*) AS pasajes FROM ranked JOIN chunks USING (id) GROUP BY clase")
def scope_facets(spark, sf):
    index, rows = stored(spark, sf)
    return R.class_facet(index, rows, "the and")[1]


@query(f"WITH {CHUNKS} SELECT id, round(CAST({_WEIGHT} AS DOUBLE), 6) AS peso FROM (SELECT *, len(regexp_extract_all(texto, '[^{_WS}]+')) AS p FROM chunks)")
def class_weights(spark, sf):
    return table(spark, sf).select("id", F.round(R.weighted(F.lit(1.0), F.col("clase"), F.col("seccion"), F.col("palabras")), 6).alias("peso"))


@query()
def page_recompose(spark, sf):
    """Every sheet with a passage, as body and notes."""
    flat = lambda c: F.trim(F.regexp_replace(c, f"{SPACE}+", " ")).alias(c)
    return R.whole_pages(table(spark, sf)).select("hoja", "canonico", flat("cuerpo"), flat("notas"))


def _names(spark, sf) -> DataFrame:
    part = read(spark, sf, "part").select(F.col("p_name").alias("nombre"), F.lower("p_name").alias("normal"), F.col("p_size").alias("cuantas"), F.col("p_brand").alias("canonico"))
    return part


@query("SELECT nombre, cuantas, canonico FROM (SELECT p_name AS nombre, lower(p_name) AS normal, p_size AS cuantas, p_brand AS canonico FROM part) WHERE contains(normal, 'widget') ORDER BY normal = 'widget' DESC, cuantas DESC, nombre LIMIT 1000000")
def names_lookup(spark, sf):
    return R.find_names(_names(spark, sf), "Widget", 1_000_000).select("nombre", "cuantas", "canonico")


@query("SELECT normal, min(nombre) AS nombre, CAST(sum(cuantas) AS BIGINT) AS peso FROM (SELECT p_name AS nombre, lower(p_name) AS normal, p_size AS cuantas FROM part) WHERE starts_with(normal, 'bl') GROUP BY normal ORDER BY peso DESC, normal LIMIT 12")
def names_suggest(spark, sf):
    return R.suggest_names(_names(spark, sf), "Bl")


@query("""WITH n AS (SELECT lower(p_name) AS normal, min(p_name) AS nombre, CAST(sum(p_size) AS BIGINT) AS peso FROM part GROUP BY 1), p AS (SELECT *, unnest(range(2, least(length(normal), 12) + 1)) AS k FROM n)
SELECT prefijo, lugar, normal, nombre, peso FROM (SELECT normal[1:k] AS prefijo, normal, nombre, peso, CAST(row_number() OVER (PARTITION BY normal[1:k] ORDER BY peso DESC, normal) AS INT) AS lugar FROM p) WHERE lugar <= 12""")
def name_completions(spark, sf):
    """The completion table of all names: for each prefix its twelve best."""
    path = work_path(spark, "completions")
    R.store_completions(_names(spark, sf), path, parts=16)
    return spark.read.parquet(path).drop("part")


@query(f"""WITH {CHUNKS}, n AS (SELECT DISTINCT source AS canonico, word, upper(word[1:1]) || word[2:] AS nombre FROM documents, (VALUES ('ther'), ('there'), ('thing'), ('tion'), ('ente')) t(word) WHERE source IS NOT NULL),
x AS (SELECT id, ' ' || regexp_replace(strip_accents(lower(texto)), '[{_WS}]+', ' ', 'g') || ' ' AS plain, canonico FROM chunks),
h AS (SELECT id, nombre, word, (length(plain) - length(replace(plain, word, ''))) // length(word) AS veces FROM x JOIN n USING (canonico) WHERE contains(plain, word)),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY veces DESC, length(nombre) DESC, nombre) AS r FROM h),
y AS (SELECT a.id, a.nombre, a.r FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.id = a.id AND b.r < a.r AND contains(b.word, a.word)))
SELECT id, string_agg(nombre, ',' ORDER BY r) AS nombres FROM y GROUP BY id""")
def passage_names(spark, sf):
    """Names of each volume in its passages, one of which is inside another."""
    rows = table(spark, sf)
    words = F.explode(F.array(*map(F.lit, ("ther", "there", "thing", "tion", "ente")))).alias("normal")
    names = read(spark, sf, "documents").where("source is not null").select(F.col("source").alias("canonico")).distinct().select("canonico", words).withColumn("nombre", F.initcap("normal"))
    return R.names_in_passages(rows, names).select("id", F.array_join("nombres", ",").alias("nombres"))


@query("SELECT 'nombre' AS campo, c_custkey AS id FROM customer WHERE contains(lower(c_name), '0012') UNION ALL SELECT 'sector', c_custkey FROM customer WHERE contains(lower(c_mktsegment), 'uild') UNION ALL SELECT 'corto', c_custkey FROM customer WHERE contains(lower(c_mktsegment), 'ur')")
def substring_filters(spark, sf):
    """Customers by a part of their name and of their segment: over stored trigrams, and by a sweep where the part is too short."""
    rows = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_mktsegment")
    index = Trigrams(spark, work_path(spark, "trigrams"), parts=16).write(rows, ["c_name", "c_mktsegment"])
    own = lambda name, column, pattern: index.filter(rows, column, pattern).select(F.lit(name).alias("campo"), "id")
    return own("nombre", "c_name", "0012").unionByName(own("sector", "c_mktsegment", "UILD")).unionByName(own("corto", "c_mktsegment", "ur"))


@query("""SELECT l_orderkey, concat_ws(' · ', 'Tomo ' || CAST(l_suppkey AS VARCHAR), CASE WHEN l_linenumber % 2 = 0 THEN 'Obra' ELSE 'Título' END,
 CASE WHEN l_linenumber % 3 = 0 AND l_partkey <> 0 THEN 'pág. ' || CAST(l_partkey AS VARCHAR) WHEN l_linenumber % 3 = 1 THEN '229D' WHEN l_orderkey <> 0 THEN 'hoja ' || CAST(l_orderkey AS VARCHAR) || ' del PDF' END, CASE WHEN l_linenumber = 4 THEN 'nota 7' END) AS cita FROM lineitem""")
def citations(spark, sf):
    n = F.col("l_linenumber")
    row = {"numero": F.col("l_suppkey").cast("string"), "obra": F.when(n % 2 == 0, "Obra").otherwise(""), "titulo": F.lit("Título"), "impresa": F.when(n % 3 == 0, F.col("l_partkey")), "versos": F.when(n % 3 == 1, "229D 229E"), "hoja": F.col("l_orderkey"), "clase": F.when(n == 4, "notas").otherwise("obra"), "nota": F.lit("7")}
    return read(spark, sf, "lineitem").select("l_orderkey", R.citation(row).alias("cita"))


@query("""SELECT clave, min(place) AS frontera FROM (SELECT user_id AS clave, m, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place,
 sum(m) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS s FROM (SELECT *, CAST(event_type IN ('click', 'view') AS INT) AS m FROM events)) WHERE m = 1 AND s >= 4 AND place < 80 GROUP BY clave""")
def run_detector(spark, sf):
    rows = read(spark, sf, "events").select(F.col("user_id").alias("clave"), "event_id", F.col("event_type").isin("click", "view").alias("m"))
    return R.first_run(rows, ["clave"], "event_id", F.col("m"))
