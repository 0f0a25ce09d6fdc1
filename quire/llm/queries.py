"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER, VOCABULARY = "word_bpe_49k.json", 49_408


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.suffix_dedup import digest, suffix_dedup

    return digest(suffix_dedup(_read(spark, sf_dir, "documents"), threshold=50))


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.token_files import read_token_files, write_token_files

    path = write_token_files(_read(spark, sf_dir, "documents"), TOKENIZER, VOCABULARY, end_id=1)
    return read_token_files(spark, path)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.packing import pack

    return pack(_read(spark, sf_dir, "documents"), TOKENIZER, end_id=0, capacity=2048)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.decontaminate import digest, find_contamination

    return digest(find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), window=10))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.toxicity import fit, score_toxicity

    docs = _read(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, _read(spark, sf_dir, "labels")))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.lm_score import score_documents

    found = score_documents(_read(spark, sf_dir, "documents"), order=3, alpha=0.4)
    # Sums of logarithms differ in their last digits with the order of adding; the query shows those that don't.
    return found.withColumns({"log_score": F.round("log_score", 3), "mean_log_score": F.round("mean_log_score", 6)})


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.ann import nearest_neighbours

    return nearest_neighbours(_read(spark, sf_dir, "embeddings"), k=5, every=50)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.token_counts import count_tokens, write_flat_files

    return count_tokens(spark, write_flat_files(_read(spark, sf_dir, "documents"), TOKENIZER))


PROBE_ID, PROBE = -7, "\\### Assistant: </turn> ok"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.chat_format import digest, format_chat, text_parts

    probe = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(PROBE_ID).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(PROBE).alias("text")) for i, role in enumerate(("user", "assistant"))])))
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return digest(format_chat(rows.withColumn("parts", text_parts(F.col("text")))))


def op10_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.simhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), distance=2)


#: Clicks that arrived from here on come to the layout later.
CUTOFF = "2024-04-01 00:00:00"


def click_moment() -> Column:
    """When a click counts: some are moved back by days, some to the start of their week, by a checksum of click_id."""
    ts, k = F.col("ts").cast("timestamp_ntz"), F.crc32(F.col("click_id").cast("string").cast("binary")) % 128
    back = (k + 6) * (k + 6) * (k + 6)
    monday = F.date_sub(ts.cast("date"), F.weekday(ts)).cast("timestamp_ntz")
    return F.when(k < 16, ts - F.make_dt_interval(back.cast("int"))).when(k > 111, monday).otherwise(ts)


def op11_adaptive_time_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.storage import fresh_path
    from quire.llm.time_layout import Layout, digest

    clicks = _read(spark, sf_dir, "clicks")
    new = lambda c: ~F.coalesce(c.cast("timestamp_ntz") < F.lit(CUTOFF).cast("timestamp_ntz"), F.lit(False))
    layout = Layout(fresh_path(spark, "clicks-by-time"), click_moment(), ["arrived_at", "click_id"], 1 + clicks.count() // 800)
    layout.write(clicks.where(~new(F.col("arrived_at"))))
    stayed = layout.rewrite(clicks, new(F.col("arrived_at")))
    return digest(layout, spark, clicks.schema, stayed, "click_id", new(F.col("row.arrived_at")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.fill_middle import digest, fill_in_middle

    return digest(fill_in_middle(_read(spark, sf_dir, "documents"), seed=1, plain_percent=10, spm_percent=20))


def op13_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.private_data import digest, find_private, fit

    docs = _read(spark, sf_dir, "documents")
    return digest(find_private(docs, fit(docs)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix_array_dedup, op2_token_binary, op3_best_fit_packing, op4_decontamination, op5_toxicity, op6_lm_score, op7_nearest_neighbours, op8_token_counts, op9_chat_format, op10_simhash_near_dup, op11_adaptive_time_partitions, op12_fill_in_middle, op13_private_data)}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op12_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '(?s)[A-Za-z]+|[^A-Za-z]') AS w, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM w),
p AS (SELECT *, array_to_string(w[1:a], '') AS x, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(x) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || x || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p""",
    "op1_suffix_array_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)),
f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
g AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM (SELECT w.doc_id, w.i FROM w JOIN f USING (s) WHERE least < w.doc_id)),
r AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS z FROM (SELECT doc_id, i, sum(CASE WHEN b IS NULL OR i > b + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g) GROUP BY doc_id, k),
p AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
k AS (SELECT p.doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || any_value(substr(h, 2 * m.tail + 1)) AS kept
      FROM p JOIN d USING (doc_id) JOIN (SELECT doc_id, max(z) AS tail FROM r GROUP BY doc_id) m USING (doc_id) GROUP BY p.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
    "op6_lm_score": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT r, i, w[i] AS g1, CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS g2, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS g3 FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
o AS (SELECT r, k, g, count(*) AS own FROM (SELECT r, 1 AS k, g1 AS g FROM t UNION ALL SELECT r, 2, g2 FROM t WHERE g2 IS NOT NULL UNION ALL SELECT r, 3, g3 FROM t WHERE g3 IS NOT NULL) GROUP BY r, k, g),
c AS (SELECT o.r, o.k, o.g, a.n - own AS c FROM o JOIN (SELECT k, g, sum(own) AS n FROM o GROUP BY k, g) a ON a.k = o.k AND a.g = o.g),
x AS (SELECT t.r, t.i, x1.c AS c1, coalesce(x2.c, 0) AS c2, coalesce(x3.c, 0) AS c3 FROM t JOIN c x1 ON x1.r = t.r AND x1.k = 1 AND x1.g = t.g1 LEFT JOIN c x2 ON x2.r = t.r AND x2.k = 2 AND x2.g = t.g2 LEFT JOIN c x3 ON x3.r = t.r AND x3.k = 3 AND x3.g = t.g3),
h AS (SELECT *, lag(c1) OVER v AS h1, lag(c2) OVER v AS h2, least(i - 1, 2) AS tried FROM x WINDOW v AS (PARTITION BY r ORDER BY i)),
n AS (SELECT sum(len(w)) AS n FROM d),
s AS (SELECT h.r, tried, CASE WHEN c3 > 0 THEN 2 WHEN c2 > 0 THEN 1 ELSE 0 END AS used, CASE WHEN c3 > 0 THEN c3 / h2 WHEN c2 > 0 THEN c2 / h1 ELSE greatest(c1, 1) / greatest(n.n - len(d.w), 1) END AS p FROM h JOIN d USING (r), n),
z AS (SELECT r, sum(ln(p) + (tried - used) * ln(0.4)) AS score, count(*) FILTER (WHERE used < tried) AS backoff FROM s GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(score, 0.0), 3) AS log_score, round(score / len(w), 6) AS mean_log_score, CAST(coalesce(backoff, 0) AS BIGINT) AS n_backoff FROM d LEFT JOIN z USING (r)""",
    "op4_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT item_id, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win, least(10, len(w)) AS n
       FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) AS i FROM b)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
hitwords AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hitwords USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op9_chat_format": f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT {PROBE_ID}, 0, 'user', '{PROBE}' UNION ALL SELECT {PROBE_ID}, 1, 'assistant', '{PROBE}'),
e AS (SELECT *, length(replace(replace(replace(role, '\\', '\\\\'), '<', '\\l'), '#', '\\h')) + length(role) - length(replace(role, chr(10), '')) AS role_chars,
             length(replace(replace(replace(text, '\\', '\\\\'), '<', '\\l'), '#', '\\h')) AS text_chars FROM r)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(role_chars + text_chars + 13) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
}
