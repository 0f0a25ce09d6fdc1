"""Full-text retrieval: passages, postings, BM25 with relaxation, facets, names, pages.

A passage table is cut from pages with native array functions.  Its postings (term, passage, frequency, positions) carry
no text, so ranking reads neither text nor other columns; text is joined back for the few passages that are shown.
A query is a handful of pieces.  Only the postings of its terms are read; one aggregation by passage gives each
passage the set of pieces it has, from which document frequencies, relaxation and scores all follow.

A stored index is made of shards, runs of SHARD passages.  A row is a term of a shard: its passages, frequencies, positions and lengths as lists, and
apart from these how many passages there are, the highest frequency and the least length, which bound what the term can add to a score.  `best` reads
these bounds alone, scores the shards that promise most, and then only those that can still reach the last of the best so far.  Rows are dealt to parts by
the first two letters of the term and sorted by it, so a term and a prefix of two or more letters both read one part.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.arrow import arrow_function
from quire.functions.text import NOT_SPACE, SPACE, compose, fold_squeezed, fold_words, greek_search_copy, let, search_tokens, strip

WINDOW, OVERLAP = 180, 40

# Voices of the sections, scopes, and weights.
WORK, EDITOR, NOTES, APPARATUS = "obra", "editor", "notas", "aparato"
CLASSES = (WORK, EDITOR, NOTES, APPARATUS)
SECTION_CLASS = {
    "texto": WORK, "introduccion": EDITOR, "notas_finales": NOTES, "bibliografia": APPARATUS,
    "indice_nombres": APPARATUS, "indice_general": APPARATUS, "abreviaturas": APPARATUS, "portada": APPARATUS,
}
SCOPES = ((WORK,), (WORK, APPARATUS), (WORK, APPARATUS, EDITOR), CLASSES)
CLASS_WEIGHT = {WORK: 1.0, EDITOR: 0.85, APPARATUS: 0.70, NOTES: 0.55}
SECTION_WEIGHT = {
    "texto": 1.0, "introduccion": 0.85, "notas_finales": 0.55, "bibliografia": 0.35,
    "indice_nombres": 0.30, "indice_general": 0.30, "abreviaturas": 0.30, "portada": 0.20,
}
LENGTH_WEIGHT = ((12, 0.40), (30, 0.65), (60, 0.88))
WITHOUT_FOOTNOTES = ("indice_nombres", "indice_general")
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Passages whose postings of one part go to one task and file: of the fullest part, which has a fifth of all, some 100 MB.
PASSAGES_A_FILE = 1 << 17
SHARD = 2048
#: Passages whose postings are sorted together before they are stored without a shuffle, and rows that go to the writer at once.
RUN = 1 << 14
#: Shards that are scored first, and how many at most are named one by one in the scan; more are joined.
SEEDS, NAMED_SHARDS = 32, 1_000


def _lookup(key: Column, table: dict, default) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(default))


# --- passages ---------------------------------------------------------------------------------------------------------


def chunks(text: Column, window: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """Passages of `window` words, each sharing `overlap` with the next; separators inside stay as they are.

    A text is cut into units of as many words as divide window and step, so a passage is a run of a few units."""
    step = max(1, window - overlap)
    unit = math.gcd(window, step)
    length, stride = window // unit, step // unit

    def cut(clean: Column, units: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(units) - length) / F.lit(float(stride)))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda i: strip(F.array_join(F.slice(units, i * stride + 1, length), "")))
        return F.when(clean == "", F.array().cast("array<string>")).when(F.size(units) <= length, F.array(clean)).otherwise(parts)

    split = lambda t: F.regexp_extract_all(t, F.lit(f"((?:{NOT_SPACE}++{SPACE}*+){{1,{unit}}})"), F.lit(1))
    return let(strip(F.coalesce(text, F.lit(""))), lambda t: let(split(t), lambda u: cut(t, u)))


def section_class(section: Column, preliminary: Column | None = None) -> Column:
    own = _lookup(F.coalesce(section, F.lit("")), SECTION_CLASS, WORK)
    return own if preliminary is None else F.when(preliminary, EDITOR).otherwise(own)


def passages(pages: DataFrame, keep: list[str], preliminary: str | None = None) -> DataFrame:
    """pages (seccion, cuerpo, notas and the columns of keep) as passages: keep, seccion, clase, orden, palabras, texto, busqueda."""
    body, notes = F.coalesce("cuerpo", F.lit("")), F.coalesce("notas", F.lit(""))
    own = section_class(F.col("seccion"), F.col(preliminary) if preliminary else None)
    both = F.array_join(F.filter(F.array(body, notes), lambda x: x != ""), "\n")
    one_list = F.col("seccion").isin(*WITHOUT_FOOTNOTES)
    parts = F.when(one_list, F.array(F.struct(own.alias("clase"), both.alias("raw")))).otherwise(F.array(F.struct(own.alias("clase"), body.alias("raw")), F.struct(F.lit(NOTES).alias("clase"), notes.alias("raw"))))
    exploded = pages.select(*keep, "seccion", F.explode(parts).alias("part"))
    cut = exploded.select(*keep, "seccion", F.col("part.clase").alias("clase"), F.posexplode(chunks(F.col("part.raw"))).alias("orden", "texto"))
    return cut.withColumn("palabras", F.regexp_count("texto", F.lit(f"{NOT_SPACE}++"))).withColumn("busqueda", greek_search_copy(F.col("texto")))


def tokenized(texts: DataFrame, id_col: str = "id", text: Column | None = None) -> DataFrame:
    """(id, tokens)"""
    return texts.select(F.col(id_col).alias("id"), search_tokens(text if text is not None else F.coalesce("busqueda", "texto")).alias("tokens"))


def _spots(tokens: DataFrame, wanted: Column) -> DataFrame:
    """(term, id, tf, positions, dl) of an array of a few terms in the tokens: no shuffle, one row for each term of a passage."""
    spots = F.transform(wanted, lambda t: F.struct(t.alias("term"), F.filter(F.transform("tokens", lambda x, i: F.when(x == t, i)), lambda i: i.isNotNull()).alias("positions")))
    return tokens.select("id", F.size("tokens").alias("dl"), F.explode(spots).alias("s")).select(F.col("s.term").alias("term"), "id", F.size("s.positions").alias("tf"), F.col("s.positions").alias("positions"), "dl")


def _invert(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.ListArray, np.ndarray]:
    """Passages (id, tokens) turned round by one sort of their tokens: for each passage and term the term, the passage's row, its frequency and
    positions; and the passages' lengths."""
    lists = batch.column(1)
    lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
    words = lists.flatten().dictionary_encode()
    code = np.asarray(words.indices).astype(np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    key = row * max(1, len(words.dictionary)) + code
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    terms = words.dictionary.take(pa.array(code[order][first]))
    spots = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(place[order], pa.int32()))
    return terms.cast(pa.string()), row[order][first], np.diff(np.append(first, len(order))), spots, lengths


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages (id, tokens) as (term, id, tf, positions, dl)."""
    for batch in batches:
        terms, row, tf, spots, lengths = _invert(batch)
        yield pa.RecordBatch.from_arrays([terms, batch.column(0).take(pa.array(row)), pa.array(tf, pa.int32()), spots, pa.array(lengths[row], pa.int32())], ["term", "id", "tf", "positions", "dl"])


def _in_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages (id, tokens) as (term, id, tf, positions, dl), in order of the term within every RUN passages."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= RUN:
            yield from _run(held)
            held, rows = [], 0
    if rows:
        yield from _run(held)


def _run(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    terms, row, tf, spots, lengths = _invert(batch)
    code = terms.dictionary_encode()
    rank = np.empty(len(code.dictionary), np.int32)
    rank[np.asarray(pc.sort_indices(code.dictionary))] = np.arange(len(code.dictionary), dtype=np.int32)
    order = np.argsort(rank[np.asarray(code.indices)], kind="stable")
    for lo in range(0, len(order), RUN):
        own = order[lo : lo + RUN]
        at = pa.array(own)
        yield pa.RecordBatch.from_arrays([terms.take(at), batch.column(0).take(pa.array(row[own])), pa.array(tf[own], pa.int32()), spots.take(at), pa.array(lengths[row[own]], pa.int32())], ["term", "id", "tf", "positions", "dl"])


def _all_spots(tokens: DataFrame) -> DataFrame:
    """(term, id, tf, positions, dl) of all terms: linear in the tokens and without a shuffle, which no native expression is."""
    kind = tokens.schema["id"].dataType.simpleString()
    return tokens.select("id", "tokens").mapInArrow(_inverted, f"term string, id {kind}, tf int, positions array<int>, dl int")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of a shard with one row a term: its passages, frequencies, positions and lengths as lists, and what bounds them."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for lo in range(0, batch.num_rows, SHARD):
            own = batch.slice(lo, SHARD)
            terms, row, tf, spots, lengths = _invert(own)
            number += 1
            if not len(terms):
                continue
            code = terms.dictionary_encode()
            rank = np.empty(len(code.dictionary), np.int64)
            rank[np.asarray(pc.sort_indices(code.dictionary))] = np.arange(len(code.dictionary))
            of = rank[np.asarray(code.indices)]
            order = np.argsort(of, kind="stable")
            first = np.flatnonzero(np.diff(of[order], prepend=-1))
            edges = pa.array(np.append(first, len(order)), pa.int32())
            dl, tfs = lengths[row], tf[order]
            # A row's positions are one list; starts says where each passage's begin.
            until = np.cumsum(tfs)
            starts = until - tfs
            begin = starts[first]
            starts = starts - np.repeat(begin, np.diff(np.append(first, len(order))))
            lists = [pa.ListArray.from_arrays(edges, x) for x in (own.column(0).take(pa.array(row[order])), pa.array(tfs, pa.int32()), pa.array(starts, pa.int32()))]
            places = pa.ListArray.from_arrays(pa.array(np.append(begin, until[-1]), pa.int32()), spots.take(pa.array(order)).flatten())
            lists += [places, pa.ListArray.from_arrays(edges, pa.array(dl[order], pa.int32()))]
            bounds = [pa.array(np.diff(np.append(first, len(order))), pa.int32()), pa.array(np.maximum.reduceat(tfs, first), pa.int32()), pa.array(np.minimum.reduceat(dl[order], first), pa.int32()), pa.array(np.add.reduceat(tfs, first), pa.int64())]
            yield pa.RecordBatch.from_arrays([terms.take(pa.array(order[first])), pa.array(np.full(len(first), number)), *bounds, *lists], ["term", "shard", "n", "tfmax", "dlmin", "cf", "ids", "tfs", "starts", "positions", "dls"])


def _unlisted(lists: DataFrame) -> DataFrame:
    """(term, id, tf, positions, dl) of stored lists."""
    own = lists.select("term", "positions", F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("tfs").alias("tf"), F.col("starts").alias("start"), F.col("dls").alias("dl"))))
    return own.select("term", "id", "tf", F.slice("positions", F.col("start") + 1, F.col("tf")).alias("positions"), "dl")


def part_of(term: Column, parts: int) -> Column:
    """The part of a term: by its first two letters, which a prefix of two letters or more has too."""
    return F.pmod(F.xxhash64(F.substring(term, 1, 2)), F.lit(parts)).cast("int")


def deal(rows: DataFrame, by: str, parts: int, passages: int) -> DataFrame:
    """Rows (part, ...) of so many passages over tasks by part and by a hash of the column `by`: what a task gets doesn't grow with the passages."""
    files = max(1, -(-passages // PASSAGES_A_FILE))
    # More tasks than parts, so that few tasks get two of them.
    return rows.repartition(4 * parts * files, "part", F.pmod(F.xxhash64(by), F.lit(files)))


def parts_asked(part: Column, terms: list[str], prefixes: list[str], parts: int) -> Column:
    """Whether a part may have one of the terms or prefixes.  Constant expressions, folded before the scan: other parts are not listed."""
    if any(len(p) < 2 for p in prefixes):
        return F.lit(True)
    return part.isin(*[part_of(F.lit(t), parts) for t in [*terms, *prefixes]]) if terms or prefixes else F.lit(False)


def postings(texts: DataFrame, id_col: str = "id", text: Column | None = None) -> DataFrame:
    return _all_spots(tokenized(texts, id_col, text))


def postings_in_runs(texts: DataFrame, id_col: str = "id", text: Column | None = None) -> DataFrame:
    """postings() in order of the term within runs of passages, as they are stored without a shuffle; the id may be a struct."""
    tokens = tokenized(texts, id_col, text)
    return tokens.select("id", "tokens").mapInArrow(_in_runs, f"term string, id {tokens.schema['id'].dataType.simpleString()}, tf int, positions array<int>, dl int")


def term_filter(term: Column, terms: list[str], prefixes: list[str]) -> Column:
    out = term.isin(*terms) if terms else F.lit(False)
    for p in prefixes:
        out = out | F.startswith(term, F.lit(p))
    return out


@dataclass
class Index:
    """What a query needs of an index: the number of passages and their mean length, and their tokens, a table of postings, or stored lists.

    Without a table only the positions of a query's own terms are worked out; with one, or with lists, only the parts of those terms are read."""

    passages: int
    mean_length: float
    ids: str = "bigint"
    tokens: DataFrame | None = None
    table: DataFrame | None = None
    lists: DataFrame | None = None
    parts: int = 0

    @property
    def words(self) -> int:
        return round(self.passages * self.mean_length) if self.passages else 0

    @staticmethod
    def build(texts: DataFrame, id_col: str = "id", text: Column | None = None) -> Index:
        tokens = tokenized(texts, id_col, text)
        total = tokens.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("mean")).collect()[0]
        return Index(total["n"], total["mean"] or 1.0, tokens.schema["id"].dataType.simpleString(), tokens=tokens)

    @staticmethod
    def write(texts: DataFrame, path: str, id_col: str = "id", text: Column | None = None, parts: int = 64, passages: int | None = None) -> Index:
        """Tokenize passages, once, and write their postings below path; passages: how many there are, if that is known.

        A part may be several files, by a hash of the shard: a term that a third of all passages have isn't one task's work."""
        spark, kind = texts.sparkSession, dict(texts.dtypes)[id_col]
        passages = texts.count() if passages is None else passages
        columns = f"term string, shard long, n int, tfmax int, dlmin int, cf long, ids array<{kind}>, tfs array<int>, starts array<int>, positions array<int>, dls array<int>"
        rows = tokenized(texts, id_col, text).select("id", "tokens").mapInArrow(_listed, columns).withColumn("part", part_of(F.col("term"), parts))
        deal(rows, "shard", parts, passages).sortWithinPartitions("part", "term", "shard").write.partitionBy("part").mode("overwrite").parquet(f"{path}/postings")
        lists = spark.read.schema(f"{columns}, part int").parquet(f"{path}/postings")
        words = lists.agg(F.sum("cf")).collect()[0][0] or 0
        spark.range(1).select(F.lit(passages).cast("long").alias("passages"), F.lit(words).cast("long").alias("words")).coalesce(1).write.mode("overwrite").parquet(f"{path}/numbers")
        return Index(passages, words / passages if words else 1.0, kind, lists=lists, parts=parts)

    @staticmethod
    def load(spark, path: str, parts: int = 64) -> Index:
        numbers, lists = spark.read.parquet(f"{path}/numbers").collect()[0], spark.read.parquet(f"{path}/postings")
        return Index(numbers["passages"], numbers["words"] / numbers["passages"] if numbers["words"] else 1.0, lists.schema["ids"].dataType.elementType.simpleString(), lists=lists, parts=parts)

    def postings(self) -> DataFrame:
        if self.lists is not None:
            return _unlisted(self.lists)
        return self.table if self.table is not None else _all_spots(self.tokens)

    def of_parts(self, rows: DataFrame, terms: list[str], prefixes: list[str] = ()) -> DataFrame:
        """The rows of some terms and of all that start with some prefixes."""
        own = rows.where(term_filter(F.col("term"), terms, list(prefixes)))
        return own.where(parts_asked(F.col("part"), terms, list(prefixes), self.parts)) if self.parts else own

    def find(self, terms: list[str], prefixes: list[str] = ()) -> DataFrame:
        """Postings of some terms and of all that start with some prefixes."""
        if self.table is not None:
            return self.of_parts(self.table, terms, prefixes)
        if self.lists is not None:
            return _unlisted(self.of_parts(self.lists, terms, prefixes))
        return _spots(self.tokens, F.filter(F.array_distinct("tokens"), lambda t: term_filter(t, terms, list(prefixes))))


# --- queries ----------------------------------------------------------------------------------------------------------

# Words without content, and the words a question is built with.
EMPTY_WORDS = {
    "a", "al", "ante", "como", "con", "contra", "de", "del", "desde", "e", "el", "en", "entre", "es", "esa", "ese", "eso", "esta", "este",
    "esto", "ha", "han", "hasta", "la", "las", "le", "les", "lo", "los", "mas", "me", "mi", "mis", "ni", "no", "nos", "o", "para", "pero",
    "por", "que", "se", "segun", "sin", "sobre", "son", "su", "sus", "tras", "un", "una", "uno", "unos", "unas", "y", "ya", "cual",
    "cuales", "cuando", "cuanto", "cuantos", "donde", "quien", "quienes",
}
QUESTION_WORDS = {
    "tomo", "tomos", "volumen", "volumenes", "libro", "libros", "obra", "obras", "habla", "hablan", "dice", "dicen", "trata", "tratan",
    "cuenta", "cuentan", "menciona", "mencionan", "aparece", "aparecen", "sale", "salen", "hay", "acerca", "respecto", "texto", "textos",
    "pasaje", "pasajes", "autor", "autores",
}
_QUESTION = re.compile(r"^\s*[¿?]|[?¿]\s*$|^\s*(que|qu[ée]|cu[áa]l|cu[áa]les|d[óo]nde|qui[ée]n|qui[ée]nes|c[óo]mo|cu[áa]ndo|cu[áa]nto|cu[áa]ntos)\b", re.I)
LEAST_PREFIX = 3


@dataclass(frozen=True)
class Piece:
    """One condition of a query: a word, a phrase, or a prefix (of its last word)."""

    text: str
    phrase: bool = False
    prefix: bool = False

    def terms(self) -> list[str]:
        plain = self.text.lower().replace("ς", "σ")
        import unicodedata

        out = []
        for c in plain:
            base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
            out.append(base if base.isascii() and base else c)
        return re.findall(r"[^\W_]+", "".join(out))


def is_question(query: str) -> bool:
    return bool(_QUESTION.search(query or ""))


def pieces(query: str) -> list[Piece]:
    """A query's conditions: all words, phrases in quotes, prefixes with a star; words without content are dropped unless nothing is left."""
    drop = EMPTY_WORDS | QUESTION_WORDS if is_question(query) else EMPTY_WORDS
    kept, every = [], []
    for raw in re.findall(r'"[^"]*"|\S+', compose(query or "")):
        phrase = raw.startswith('"')
        prefix = not phrase and raw.endswith("*") and len(raw) > 1
        token = re.sub(r"[^\w\s]", " ", raw.strip('"') if phrase else raw[:-1] if prefix else raw).strip()
        if not token:
            continue
        piece = Piece(token, phrase, prefix and len(token) >= LEAST_PREFIX)
        every.append(piece)
        if phrase or piece.prefix or fold_words(token) not in drop:
            kept.append(piece)
    return kept or every


def only_empty_words(query: str) -> bool:
    drop = EMPTY_WORDS | QUESTION_WORDS if is_question(query) else EMPTY_WORDS
    own = pieces(query)
    return bool(own) and all(fold_words(p.text) in drop for p in own)


def piece_hits(index: Index, own: list[Piece]) -> DataFrame:
    """(piece, id, tf, dl): where each piece of a query occurs and how often, and how long the passage is."""
    singles, parts = {}, []
    for k, p in enumerate(own):
        terms = p.terms()
        if len(terms) == 1 and not p.prefix:
            singles.setdefault(terms[0], []).append(k)
        elif len(terms) == 1:
            rows = index.find([], [terms[0]])
            parts.append(rows.groupBy("id").agg(F.sum("tf").alias("tf"), F.max("dl").alias("dl")).select(F.lit(k).alias("piece"), "id", "tf", "dl"))
        elif terms:
            parts.append(_phrase(index, k, terms, p.prefix))
    if singles:
        table = F.create_map(*[x for t, ks in singles.items() for x in (F.lit(t), F.array(*map(F.lit, ks)))])
        rows = index.find(list(singles))
        parts.insert(0, rows.select(F.explode(table[F.col("term")]).alias("piece"), "id", F.col("tf").cast("long").alias("tf"), "dl"))
    if not parts:
        return index.postings().select(F.lit(0).alias("piece"), "id", F.lit(0).cast("long").alias("tf"), "dl").limit(0)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _phrase(index: Index, k: int, terms: list[str], prefix: bool) -> DataFrame:
    """Consecutive positions of all terms; the last may be a prefix."""
    last = F.startswith("term", F.lit(terms[-1])) if prefix else F.col("term") == terms[-1]
    rows = index.find(terms[:-1], [terms[-1]]) if prefix else index.find(terms)
    spots = rows.groupBy("id").agg(
        *[F.flatten(F.collect_list(F.when(F.col("term") == t, F.col("positions")))).alias(f"p{i}") for i, t in enumerate(terms[:-1])],
        F.flatten(F.collect_list(F.when(last, F.col("positions")))).alias(f"p{len(terms) - 1}"),
        F.max("dl").alias("dl"),
    )
    starts = F.col("p0")
    for i in range(1, len(terms)):
        starts = F.array_intersect(starts, F.transform(f"p{i}", lambda x: x - i))
    return spots.select(F.lit(k).alias("piece"), "id", F.size(starts).cast("long").alias("tf"), "dl").where("tf > 0")


@dataclass
class Plan:
    """What a query comes down to: how it was read, and the pieces that are required."""

    mode: str  # vacia, todas, algunas, solo_vacias
    used: list[int]
    pieces: list[Piece]
    frequency: dict[int, int] = field(default_factory=dict)
    shards: tuple[int, int] | None = field(default=None, compare=False)  # those with all pieces, and those that were scored

    @property
    def words(self) -> list[str]:
        return [self.pieces[i].text for i in self.used]


def relax(query: str, own: list[Piece], sets: dict[frozenset[int], int]) -> Plan:
    """All pieces; if no passage has them all, without those that never occur, then without the commonest one after the other.

    sets: how many passages have exactly each set of pieces."""
    if not own:
        return Plan("vacia", [], own)
    df = {k: sum(n for s, n in sets.items() if k in s) for k in range(len(own))}
    every = list(range(len(own)))
    mode = "solo_vacias" if only_empty_words(query) else "todas"
    some = lambda used: any(set(used) <= s for s in sets)
    if some(every) or len(own) == 1:
        return Plan(mode, every, own, df)
    rare = [k for k in sorted(every, key=lambda k: df[k]) if df[k]]
    for n in range(len(rare) if len(rare) < len(own) else len(rare) - 1, 0, -1):
        if some(rare[:n]):
            return Plan("algunas", rare[:n], own, df)
    return Plan(mode, every, own, df)


def plan(index: Index, query: str) -> tuple[Plan, DataFrame]:
    """The relaxed plan of a query and its pieces' hits.  What comes to the driver is one count for each set of pieces."""
    own = pieces(query)
    hits = piece_hits(index, own)
    if index.tokens is not None:
        hits = hits.persist()  # only the query's terms; a stored index reads them again
    by_set = hits.groupBy("id").agg(F.sort_array(F.collect_set("piece")).alias("have")).groupBy("have").count().collect() if own else []
    return relax(query, own, {frozenset(r["have"]): r["count"] for r in by_set}), hits


def idf(passages: int, frequency: int) -> float:
    return max(LEAST_IDF, math.log((passages - frequency + 0.5) / (frequency + 0.5)) if frequency <= passages else LEAST_IDF)


def _contribution(tf: Column, dl: Column, mean: float) -> Column:
    """What a frequency in a passage of a length adds for an idf of 1: it grows with tf and falls with dl."""
    return (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / F.lit(float(mean))))


def rank(index: Index, decided: Plan, hits: DataFrame) -> DataFrame:
    """(id, bm) of the passages that have all required pieces; smaller is better.  Counts are those of the whole index."""
    if not decided.used:
        return hits.select("id", F.lit(0.0).alias("bm")).limit(0)
    weights = {k: idf(index.passages, decided.frequency[k]) for k in decided.used}
    part = _lookup(F.col("piece"), weights, 0.0) * _contribution(F.col("tf"), F.col("dl"), index.mean_length)
    scored = hits.where(F.col("piece").isin(*decided.used)).groupBy("id").agg(F.sum(part).alias("s"), F.count("*").alias("have"))
    return scored.where(F.col("have") == len(decided.used)).select("id", (-F.col("s")).alias("bm"))


def best(index: Index, query: str, rows: DataFrame, limit: int) -> tuple[Plan, DataFrame] | None:
    """The `limit` best rows (id, ...) that have all pieces of a query, with bm, as by plan() and rank(): from a stored index and for pieces that are single
    words.  Without such an index, for other queries, and where nothing is found, None.

    Document frequencies and the bounds of each shard come from the rows' small columns.  The SEEDS shards of the highest bounds are scored; if they
    have `limit` rows, shards that can't reach the last of these are never read.  Bounds are rounded up, so equal scores are not lost."""
    own = pieces(query)
    terms = [p.terms() for p in own]
    if index.lists is None or not own or any(len(t) != 1 or p.prefix for t, p in zip(terms, own, strict=True)) or len({t[0] for t in terms}) < len(own):
        return None
    words = [t[0] for t in terms]
    bounds = index.of_parts(index.lists, words).select("term", "shard", "n", "tfmax", "dlmin")
    frequency = {r["term"]: r["df"] for r in bounds.groupBy("term").agg(F.sum("n").alias("df")).collect()}
    if len(frequency) < len(words):
        return None
    decided = Plan("solo_vacias" if only_empty_words(query) else "todas", list(range(len(own))), own, {k: frequency[w] for k, w in enumerate(words)})
    weights = {w: idf(index.passages, frequency[w]) for w in words}
    most = F.sum(_lookup(F.col("term"), weights, 0.0) * _contribution(F.col("tfmax"), F.col("dlmin"), index.mean_length)) * (1 + 1e-9)
    promise = bounds.groupBy("shard").agg(most.alias("most"), F.count("*").alias("have")).where(F.col("have") == len(words))
    piece = {w: k for k, w in enumerate(words)}

    def scored(own_shards: DataFrame) -> DataFrame:
        hits = _unlisted(own_shards).select(_lookup(F.col("term"), piece, -1).alias("piece"), "id", F.col("tf").cast("long").alias("tf"), "dl")
        return rank(index, decided, hits).join(rows, "id").orderBy("bm", "id").limit(limit)

    lists = index.of_parts(index.lists, words)
    seeds = [r["shard"] for r in promise.orderBy(F.desc("most"), "shard").limit(SEEDS).collect()]
    if not seeds:
        return None
    reached = scored(lists.where(F.col("shard").isin(*seeds))).agg(F.count("*").alias("n"), F.max("bm").alias("last")).collect()[0]
    wanted = promise.where(F.col("most") >= -reached["last"]) if reached["n"] >= limit else promise
    named = [r["shard"] for r in wanted.select("shard").limit(NAMED_SHARDS + 1).collect()]
    decided.shards = promise.count(), len(named) if len(named) <= NAMED_SHARDS else wanted.count()
    found = scored(lists.where(F.col("shard").isin(*named)) if len(named) <= NAMED_SHARDS else lists.join(wanted.select("shard"), "shard", "left_semi"))
    return None if not reached["n"] and found.isEmpty() else (decided, found)


def length_weight(words: Column) -> Column:
    out = F.lit(1.0)
    for least, weight in reversed(LENGTH_WEIGHT):
        out = F.when(words < least, weight).otherwise(out)
    return out


def weighted(score: Column, kind: Column, section: Column, words: Column) -> Column:
    return score * _lookup(kind, CLASS_WEIGHT, 1.0) * _lookup(section, SECTION_WEIGHT, 0.8) * length_weight(words)


def scope_filter(classes: tuple[str, ...] | None) -> Column:
    """The classes asked for; nothing to filter if those are all."""
    return F.lit(True) if not classes or set(classes) == set(CLASSES) else F.col("clase").isin(*classes)


def search(index: Index, table: DataFrame, query: str, limit: int = 40, classes: tuple[str, ...] | None = None, volume: str = "", author: str = "", work: str = "", candidates: int = 400, per_volume: int = 3) -> tuple[Plan, DataFrame]:
    """The best passages: the top candidates by BM25 after the filters, weighted, one a page and class, at most per_volume a volume.

    table has id, canonico, autor, obra, hoja, clase, seccion, palabras and whatever else is to come back."""
    rows = table.where(scope_filter(classes))
    if volume:
        rows = rows.where(F.col("canonico") == volume)
    if author:
        rows = rows.where(F.contains(F.lower("autor"), F.lit(author.lower())))
    if work:
        rows = rows.where(F.contains(F.lower("obra"), F.lit(work.lower())))
    found = best(index, query, rows, max(limit, candidates))
    if found is None:
        decided, hits = plan(index, query)
        found = decided, rank(index, decided, hits).join(rows, "id").orderBy("bm", "id").limit(max(limit, candidates))
    decided, top = found
    top = top.withColumn("peso", weighted(F.col("bm"), F.col("clase"), F.col("seccion"), F.col("palabras")))
    # At most `candidates` rows from here on.
    order = [F.asc("peso"), F.asc("bm"), F.asc("id")]
    once = top.withColumn("__first", F.row_number().over(Window.partitionBy("canonico", "hoja", "clase").orderBy(*order))).where("__first = 1").drop("__first")
    if per_volume:
        once = once.withColumn("__place", F.row_number().over(Window.partitionBy("canonico").orderBy(*order))).where(F.col("__place") <= per_volume).drop("__place")
    return decided, once.orderBy(*order).limit(limit)


def volume_facet(index: Index, table: DataFrame, query: str, classes: tuple[str, ...] | None = None) -> tuple[Plan, DataFrame]:
    """Every volume with hits: how many passages and pages; complete, without a cap."""
    decided, hits = plan(index, query)
    rows = rank(index, decided, hits).select("id").join(table.where(scope_filter(classes)).select("id", "canonico", "hoja"), "id")
    return decided, rows.groupBy("canonico").agg(F.count("*").alias("pasajes"), F.countDistinct("hoja").alias("hojas"))


def class_facet(index: Index, table: DataFrame, query: str) -> tuple[Plan, DataFrame]:
    """Volumes and passages by class: says where a query would be found outside its scope."""
    decided, hits = plan(index, query)
    rows = rank(index, decided, hits).select("id").join(table.select("id", "canonico", "clase"), "id")
    return decided, rows.groupBy("clase").agg(F.countDistinct("canonico").alias("tomos"), F.count("*").alias("pasajes"))


# --- names ------------------------------------------------------------------------------------------------------------

# Entries that are not names.
NOT_NAMES = ["y ss", "ss", "id", "ibid", "cf", "vid", "op cit", "passim", "et al", "n", "nn", "pag", "pags", "vol", "vols", "s v"]


def is_name(name: Column) -> Column:
    plain = fold_squeezed(name)
    return (F.length(plain) >= 3) & ~plain.isin(*NOT_NAMES) & ~F.replace(plain, F.lit(" "), F.lit("")).rlike("^[ivxlcdm]+$") & plain.rlike(r"\p{L}")


def load_names(volumes: DataFrame, keep: list[str]) -> DataFrame:
    """The concordance of each volume (map of name to references) as rows."""
    rows = volumes.select(*keep, F.explode("indice_nombres").alias("raw", "list"))
    refs = F.filter(F.transform(F.coalesce("list", F.array().cast("array<string>")), strip), lambda r: r != "")
    named = rows.select(*keep, strip(F.col("raw")).alias("nombre"), refs.alias("refs"))
    return named.where(is_name(F.col("nombre"))).select(*keep, "nombre", fold_squeezed(F.col("nombre")).alias("normal"), F.array_join("refs", "; ").alias("refs"), F.size("refs").alias("cuantas"))


def find_names(names: DataFrame, query: str, limit: int = 60) -> DataFrame:
    """Names that are or contain the query, exact ones first, then by references."""
    key = fold_words(query)
    if not key:
        return names.limit(0)
    return names.where(F.contains("normal", F.lit(key))).orderBy((F.col("normal") == key).desc(), F.desc("cuantas"), "nombre").limit(limit)


def suggest_names(names: DataFrame, prefix: str, limit: int = 12) -> DataFrame:
    """Names that start so, by their references in all volumes."""
    key = fold_words(prefix)
    rows = names.where(F.startswith("normal", F.lit(key))) if len(key) >= 2 else names.limit(0)
    return rows.groupBy("normal").agg(F.min("nombre").alias("nombre"), F.sum("cuantas").alias("peso")).orderBy(F.desc("peso"), "normal").limit(limit)


DEEPEST, KEPT = 12, 12


def completions(names: DataFrame) -> DataFrame:
    """(prefijo, lugar, normal, nombre, peso): for each prefix of two to DEEPEST letters the KEPT names of most references, as suggest_names orders them.
    Places are limited before the shuffle, so a prefix that many names have isn't one task's work."""
    own = names.groupBy("normal").agg(F.min("nombre").alias("nombre"), F.sum("cuantas").alias("peso")).where("length(normal) >= 2")
    prefixes = F.transform(F.sequence(F.lit(2), F.least(F.length("normal"), F.lit(DEEPEST))), lambda k: F.substring(F.col("normal"), F.lit(1), k))
    place = F.row_number().over(Window.partitionBy("prefijo").orderBy(F.desc("peso"), "normal"))
    return own.select(F.explode(prefixes).alias("prefijo"), "normal", "nombre", "peso").withColumn("lugar", place).where(F.col("lugar") <= KEPT)


def store_completions(names: DataFrame, path: str, parts: int = 64) -> None:
    rows = completions(names).withColumn("part", part_of(F.col("prefijo"), parts))
    rows.repartition("part").sortWithinPartitions("part", "prefijo", "lugar").write.partitionBy("part").mode("overwrite").parquet(path)


def complete(stored: DataFrame, prefix: str, parts: int = 64, limit: int = KEPT) -> DataFrame | None:
    """suggest_names from stored completions: one part is read, and nothing is aggregated.  None for prefixes that are longer than those
    kept: suggest_names answers them."""
    key = fold_words(prefix)
    if len(key) > DEEPEST or limit > KEPT:
        return None
    if len(key) < 2:
        return stored.limit(0).select("normal", "nombre", "peso")
    own = stored.where((F.col("part") == part_of(F.lit(key), parts)) & (F.col("prefijo") == key) & (F.col("lugar") <= limit))
    return own.orderBy("lugar").select("normal", "nombre", "peso")


#: Passages of a volume that one automaton reads, about.
PASSAGES_A_TASK = 4_096


def _named(most: int):
    """The names of a volume found in its passages: one automaton over the names, one pass over each text."""

    def run(texts: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
        by_head: dict[str, list[tuple[str, str]]] = {}
        for head, name, plain in zip(heads["head"], heads["nombre"], heads["entera"], strict=True):
            by_head.setdefault(head, []).append((name, plain))
        automaton = ahocorasick.Automaton()
        for head in by_head:
            automaton.add_word(head, head)
        if by_head:
            automaton.make_automaton()
        ids, names = [], []
        for key, text in zip(texts["id"].tolist(), texts["plain"], strict=True) if by_head else ():
            found = {(-text.count(head), -len(name), name, plain) for head in {h for _, h in automaton.iter(text)} for name, plain in by_head[head]}
            kept: list[tuple[str, str]] = []
            for _, _, name, plain in sorted(found):
                if not any(plain in other for _, other in kept):
                    kept.append((name, plain))
            if kept:
                ids.append(key)
                names.append([name for name, _ in kept[:most]])
        return pd.DataFrame({"id": pd.Series(ids, dtype=object), "nombres": pd.Series(names, dtype=object)})

    return run


def names_in_passages(table: DataFrame, names: DataFrame, most: int = 6) -> DataFrame:
    """(id, nombres): names of a passage's volume that occur in it, by how often and how long, without those inside others.

    A passage is read once, for all names; a large volume is divided, and its names go to each share."""
    first = lambda c: strip(F.get(F.split(c, ","), F.lit(0)))
    heads = names.select("canonico", first("nombre").alias("nombre"), first("normal").alias("head")).where("length(head) >= 4").distinct().withColumn("entera", fold_squeezed(F.col("nombre")))
    rows = table.select("id", "canonico", fold_squeezed(F.col("texto")).alias("plain")).where("canonico is not null and plain is not null")
    shares = rows.groupBy("canonico").agg(F.ceil(F.count("*") / F.lit(PASSAGES_A_TASK)).cast("int").alias("shares"))
    dealt = rows.join(shares, "canonico").select("canonico", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int").alias("share"), "id", "plain")
    sent = heads.join(shares, "canonico").select("canonico", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "nombre", "head", "entera")
    kind = dict(table.dtypes)["id"]
    return dealt.groupBy("canonico", "share").cogroup(sent.groupBy("canonico", "share")).applyInPandas(_named(most), f"id {kind}, nombres array<string>")


# --- presentation -----------------------------------------------------------------------------------------------------


def citation(row: dict[str, Column] | None = None) -> Column:
    """Where a passage is: volume, work, printed page before verse before sheet, and whether in a note."""
    c = row or {n: F.col(n) for n in ("numero", "obra", "titulo", "impresa", "versos", "hoja", "clase", "nota")}
    have = lambda x: F.coalesce(x, F.lit("")) != ""
    work = F.when(have(c["obra"]) & (c["obra"] != F.coalesce(c["titulo"], F.lit(""))), c["obra"]).when(have(c["titulo"]), c["titulo"])
    place = (
        F.when(F.coalesce(c["impresa"], F.lit(0)) != 0, F.concat(F.lit("pág. "), c["impresa"].cast("string")))
        .when(have(c["versos"]), F.get(F.split(c["versos"], " "), F.lit(0)))
        .when(F.coalesce(c["hoja"], F.lit(0)) != 0, F.concat(F.lit("hoja "), c["hoja"].cast("string"), F.lit(" del PDF")))
    )
    note = F.when(c["clase"] == NOTES, F.when(have(c["nota"]), F.concat(F.lit("nota "), c["nota"])).otherwise("en nota"))
    return F.concat_ws(" · ", F.when(have(c["numero"]), F.concat(F.lit("Tomo "), c["numero"])), work, place, note)


def rejoin_parts(parts: list[str], overlap: int = OVERLAP) -> str:
    """Passages of a page, in order, as one text: what two neighbours share is there once.  A shared run of exactly the overlap counts first (in
    text that repeats itself a longer one would take words away), else the longest of up to overlap + 5 and over 3 words; without one they
    follow on a line of their own."""
    whole = ""
    for k, part in enumerate(parts):
        if not k:
            whole = part
            continue
        words, whole = re.findall(r"\S+\s*", part), whole.rstrip()
        for n in [overlap] * (3 < overlap <= len(words)) + list(range(min(overlap + 5, len(words)), 3, -1)):
            if whole.endswith("".join(words[:n]).strip()):
                whole += " " + "".join(words[n:])
                break
        else:
            whole += "\n" + part
    return whole.strip()


@arrow_function("string")
def rejoin(pieces_: pd.Series) -> pd.Series:
    return pieces_.map(lambda parts: None if parts is None else rejoin_parts(list(parts)))


def whole_pages(table: DataFrame) -> DataFrame:
    """One row a page with its body and notes put together again."""
    order = F.sort_array(F.collect_list(F.struct(F.when(F.col("clase") == NOTES, 1).otherwise(0).alias("n"), F.col("clase").alias("c"), "orden", "texto")))
    grouped = table.groupBy("canonico", "hoja").agg(order.alias("rows"))
    part = lambda n: rejoin(F.transform(F.filter("rows", lambda r: r["n"] == n), lambda r: r["texto"]))
    return grouped.select("canonico", "hoja", part(0).alias("cuerpo"), part(1).alias("notas"))


def whole_page(table: DataFrame, volume: str, sheet: int) -> DataFrame:
    """One row with a page's body and notes put together again."""
    return whole_pages(table.where((F.col("canonico") == volume) & (F.col("hoja") == sheet)))


# --- passage of the day -----------------------------------------------------------------------------------------------

# Headings of the editor's apparatus, and how much of a volume's start is skipped.
ROUTINE = [
    "bibliograf", "nota ", "notas", "indice", "abreviatur", "advertencia", "sigla", "apendice", "prologo", "cronolog", "traduccion",
    "edicion", "comentario", "estudio", "introducc", "argumento", "sinopsis", "esquema", "resumen", "presentacion", "manuscrito",
    "aparato", "stemma", "conspectus",
]
SKIPPED_SHARE = 0.18


def dice(date: str, low: int, high: int) -> int:
    """A day's throw over a range of ids: the date's SHA-1, modulo the range."""
    import hashlib

    return int(hashlib.sha1(date.encode()).hexdigest(), 16) % max(1, high - low + 1) + low


def day_candidates(table: DataFrame, start: int, look: int = 200) -> DataFrame:
    """From the first `look` rows of suitable length from id `start` on, those past a volume's front matter and without a routine heading."""
    rows = table.where((F.col("id") >= start) & (F.col("clase") == WORK) & (F.col("seccion") == "texto") & F.col("palabras").between(110, 190) & (F.col("nombres") > 0)).orderBy("id").limit(look)
    early = (F.coalesce("hojas", F.lit(0)) > 0) & (F.coalesce("hoja", F.lit(0)) < F.col("hojas") * SKIPPED_SHARE)
    label = fold_squeezed(F.concat_ws(" ", F.coalesce("titulo", F.lit("")), F.coalesce("obra", F.lit(""))))
    routine = let(label, lambda x: F.exists(F.array(*map(F.lit, ROUTINE)), lambda r: F.contains(x, r)))
    return rows.where(~early & ~routine)


def passage_of_the_day(table: DataFrame, names: DataFrame, date: str) -> DataFrame:
    """One passage a date: thrown by id, never by sorting the table; the first of up to 40 that holds two names of its volume, else one,
    else the first.  What comes to the driver are at most 200 ids."""
    ends = table.agg(F.min("id").alias("a"), F.max("id").alias("b")).collect()[0]
    if ends["a"] is None:
        return table.limit(0)
    thrown = dice(date, ends["a"], ends["b"])
    for start in (thrown, ends["a"]):
        ids = [r["id"] for r in day_candidates(table, start).select("id").orderBy("id").collect()]
        if ids:
            break
    else:
        fallback = table.where((F.col("clase") == WORK) & (F.col("palabras") >= 8))
        n = fallback.count()
        if not n:
            return table.limit(0)
        ids = [r["id"] for r in fallback.select("id").orderBy("id").offset(thrown % n).limit(40).collect()]
        thrown = 0
    turn = thrown % len(ids)
    turned = (ids[turn:] + ids[:turn])[:40]
    held = {r["id"]: len(r["nombres"]) for r in names_in_passages(table.where(F.col("id").isin(*turned)), names, 3).collect()}
    for least in (2, 1):
        for i in turned:
            if held.get(i, 0) >= least:
                return table.where(F.col("id") == i)
    return table.where(F.col("id") == turned[0])


def sticky_passage(table: DataFrame, names: DataFrame, meta: DataFrame, date: str) -> tuple[DataFrame, DataFrame]:
    """(passage, meta): the day's passage, the same all day.  What was thrown is kept in meta (clave, valor); it is thrown again where that is of another day or
    its passage is gone."""
    key = "pasaje_del_dia"
    stored = meta.where(F.col("clave") == key).select(F.get_json_object("valor", "$.fecha").alias("fecha"), F.get_json_object("valor", "$.id").try_cast("bigint").alias("id")).head()
    if stored is not None and stored["fecha"] == date and stored["id"] is not None:
        own = table.where(F.col("id") == stored["id"])
        if not own.isEmpty():
            return own, meta
    chosen = passage_of_the_day(table, names, date)
    row = chosen.select("id").head()
    if row is None:
        return chosen, meta
    value = json.dumps({"fecha": date, "id": row["id"]})
    return chosen, meta.where(F.col("clave") != key).unionByName(meta.sparkSession.createDataFrame([(key, value)], "clave string, valor string"))


# --- editor's preliminaries -------------------------------------------------------------------------------------------

# Headings of front matter.
EDITORIAL = [
    "sinopsis", "introduccion", "nota bibliografica", "nota textual", "nota editorial", "nota preliminar", "nota a la traduccion",
    "nota sobre la traduccion", "sobre la presente traduccion", "la presente traduccion", "nuestra edicion", "nuestra traduccion",
    "bibliografia", "ediciones", "traducciones", "estudios", "comentarios", "variantes", "divergencias", "codices", "manuscritos",
    "tradicion manuscrita", "transmision del texto", "abreviaturas", "siglas", "cronologia", "conspectus siglorum",
]
RUN_WINDOW, RUN_LEAST, FRONTIER_MOST, SCHEME_LEAST = 6, 4, 80, 3
_NUMBERED = rf"^{SPACE}*([0-9]+(?:{SPACE}*\.{SPACE}*[0-9]+)*){SPACE}*\.?{SPACE}+{NOT_SPACE}"


def first_run(rows: DataFrame, by: list[str], order: str, mark: Column, window: int = RUN_WINDOW, least: int = RUN_LEAST, most: int = FRONTIER_MOST) -> DataFrame:
    """(by, frontera): in each group, the place (from 0, below most) of the first marked row that begins a run: at least `least` of `window` rows."""
    over = Window.partitionBy(*by).orderBy(order)
    placed = rows.select(*by, mark.cast("int").alias("m"), (F.row_number().over(over) - 1).alias("place"), F.sum(mark.cast("int")).over(over.rowsBetween(0, window - 1)).alias("marks"))
    return placed.where((F.col("m") == 1) & (F.col("marks") >= least) & (F.col("place") < most)).groupBy(*by).agg(F.min("place").alias("frontera"))


def preliminaries(pages: DataFrame, volume: str = "canonico", order: str = "pdf") -> DataFrame:
    """(volume, order) of pages of section "texto" that are the editor's: before their work's first run of margin references, without one
    themselves, and titled as front matter or by a numbered scheme."""
    texts = pages.where("seccion = 'texto'").withColumn("__work", strip(F.coalesce("obra", F.lit("")))).withColumn("__mark", F.size(F.coalesce("versos", F.array().cast("array<string>"))) > 0)
    by = [volume, "__work"]
    frontier = first_run(texts, by, order, F.col("__mark"))
    placed = texts.withColumn("__place", F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1).join(frontier, by).where("__place < frontera")
    title = F.coalesce("titulo", F.lit(""))
    number = F.when(title.rlike(_NUMBERED), F.regexp_extract(title, _NUMBERED, 1))
    scheme = F.size(F.collect_set(number).over(Window.partitionBy(*by))) >= SCHEME_LEAST
    plain = F.regexp_replace(fold_squeezed(title), r"^[0-9]+(\s*\.\s*[0-9]+)*\s*\.?\s*", "")
    editorial = let(plain, lambda x: F.exists(F.array(*map(F.lit, EDITORIAL)), lambda r: F.startswith(x, r)))
    judged = placed.withColumn("__scheme", scheme & number.isNotNull()).withColumn("__editorial", editorial)
    return judged.where(~F.col("__mark") & (F.col("__editorial") | F.col("__scheme"))).select(volume, order)
