"""Toxicity by a weighted finite-state grammar over clauses.

A text is cut into clauses and its tokens become symbols: insult, threat, target, negation, reported speech, quote, other.
Small transducers each add a mark to insults and threats: one for negation in front, one for reported speech, one for a
target in front and, read from the right, one for a target behind.  They are composed into one machine.  What it
writes for a clause are marked matches, so that "you are an idiot", "he is not an idiot" and "she said he was an idiot" are three
different symbols with weights of their own.  A document's score is a logistic function of its matches.

The words of the grammar are the fixed lists below and what is learned: words of any length, and stems of four to seven
letters, that labelled documents of label 1 share, in different surroundings, and those of label 0 do not.  A learned term that
mostly stands right before a target ("zork you") is a threat, any other an insult.  Terms and weights are fitted on at most
`fit_rows` labelled rows (a hash sample; 20,000 by default), so nothing that is collected or broadcast grows with the corpus.
Terms are counted and chosen by joins; only those that tell label 1 are collected.  Where no labels can be used, the
fixed lists and prior weights score alone.

Scores depend on nothing but the text.  A null text is an empty one and scores like any text without a match; a very long one is
read whole.  Labels of rows that share a doc_id count by their mean, and so do those of rows that share a text;
rows without doc_id have no label and are not held out.  Repeated rows are scored each.  Extra columns, whatever their
names, are neither read nor lost: drop_toxic returns them.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.memory import lean

FIT_ROWS = 20_000

# Word lists of the grammar.
INSULTS = {
    "idiot", "idiots", "moron", "morons", "imbecile", "stupid", "scum", "trash", "loser", "losers", "pathetic", "worthless",
    "disgusting", "clown", "vermin", "filth", "dumbass", "bastard", "bitch", "asshole", "retard", "freak", "parasite",
    "dummkopf", "idioten", "abschaum", "arschloch", "trottel", "connard", "imbécile", "ordure", "salaud", "crétin",
    "idiota", "imbécil", "escoria", "basura", "estúpido", "estúpida", "cabrón",
}
THREATS = {"kill", "hurt", "murder", "destroy", "strangle", "shoot", "stab", "beat", "töten", "umbringen", "tuer", "frapper", "matar", "golpear"}
TARGETS = {"you", "your", "he", "she", "they", "him", "her", "them", "u", "du", "ihr", "dich", "euch", "tu", "toi", "vous", "te", "tú", "usted", "vosotros", "ustedes"}
NEGATIONS = {"not", "no", "never", "isn", "aren", "wasn", "don", "without", "nicht", "kein", "keine", "nie", "pas", "jamais", "sans", "nunca", "jamás", "sin"}
REPORTS = {"said", "says", "called", "calls", "wrote", "claimed", "quoted", "reported", "sagte", "schrieb", "nannte", "dit", "écrit", "appelé", "dijo", "escribió", "llamó"}
QUOTES = {'"', "“", "”", "«", "»", "„"}

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)
NEGATED, REPORTED, TARGETED = 8, 16, 32
#: The matches that are told apart: insult or threat, with each set of marks.
MATCHES = [kind | n | r | t for kind in (INSULT, THREAT) for n, r, t in product((0, NEGATED), (0, REPORTED), (0, TARGETED))]
#: Weights before any label is seen, and the bias.
PRIOR = {m: (3.5 if m & 7 == INSULT else 1.0) * (0.4 if m & NEGATED else 1) * (0.6 if m & REPORTED else 1) + (1.0 if m & TARGETED else 0) for m in MATCHES}
PRIOR_BIAS = -2.5

_TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]+|[\"“”«»„]")
_END = re.compile(r"[.!?;\n]")
_LETTER = re.compile(r"[^\W\d_]")


# --- transducers ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer: step maps a state and a symbol to the next state and what is written."""

    start: object
    step: Callable[[object, int], tuple[object, int]]

    def compose(self, other: Transducer) -> Transducer:
        """First this one, and what it writes goes to the other."""

        def step(state, symbol):
            a, written = self.step(state[0], symbol)
            b, out = other.step(state[1], written)
            return (a, b), out

        return Transducer((self.start, other.start), step)

    def table(self, symbols: Iterable[int]) -> list[dict[int, tuple[int, int]]]:
        """The machine over all states that can be reached, as a table; state 0 is the start."""
        number, rows, symbols = {self.start: 0}, [], list(symbols)
        queue = [self.start]
        for state in queue:
            row = {}
            for s in symbols:
                after, out = self.step(state, s)
                if after not in number:
                    number[after] = len(number)
                    queue.append(after)
                row[s] = (number[after], out)
            rows.append(row)
        return rows


def _match(symbol: int) -> bool:
    return symbol & 7 in (INSULT, THREAT)


def scope(cue: int, reach: int, mark: int) -> Transducer:
    """Marks matches up to `reach` tokens after a cue."""

    def step(left, symbol):
        if symbol & 7 == cue:
            return reach, symbol
        out = symbol | mark if left and _match(symbol) else symbol
        return max(0, left - 1), out

    return Transducer(0, step)


def after_cue(cue: int, mark: int) -> Transducer:
    """Marks matches from a cue to the clause's end."""
    return Transducer(False, lambda on, symbol: (on or symbol & 7 == cue, symbol | mark if on and _match(symbol) else symbol))


def inside_quotes(mark: int) -> Transducer:
    return Transducer(False, lambda on, symbol: (not on if symbol & 7 == QUOTE else on, symbol | mark if on and _match(symbol) else symbol))


_PLAIN = list(range(7))
BACKWARD = scope(TARGET, 2, TARGETED).table(_PLAIN)
_WRITTEN = [*_PLAIN, INSULT | TARGETED, THREAT | TARGETED]
FORWARD = scope(NEGATION, 3, NEGATED).compose(after_cue(REPORT, REPORTED)).compose(inside_quotes(REPORTED)).compose(scope(TARGET, 4, TARGETED)).table(_WRITTEN)


def run(table: list[dict[int, tuple[int, int]]], symbols: list[int]) -> list[int]:
    state, out = 0, []
    for s in symbols:
        state, written = table[state][s]
        out.append(written)
    return out


def clause_matches(symbols: list[int]) -> list[int]:
    """The marked matches of one clause."""
    return [s for s in run(FORWARD, run(BACKWARD, symbols[::-1])[::-1]) if _match(s)]


# --- words and documents ----------------------------------------------------------------------------------------------


class Grammar:
    """Word lists with learned words (matched whole) and stems (matched from a word's start), and the weights of matches.

    `threats` are those of the learned words and stems that are threats."""

    def __init__(self, words: Iterable[str] = (), stems: Iterable[str] = (), weights: dict[int, float] | None = None, bias: float = PRIOR_BIAS, threats: Iterable[str] = ()) -> None:
        self.words, self.stems, self.threats = set(words), set(stems), set(threats)
        self.weights, self.bias = weights or dict(PRIOR), bias
        learned = {w: THREAT if w in self.threats else INSULT for w in self.words}
        self.kind = {w: k for k, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (QUOTE, QUOTES), (THREAT, THREATS), (INSULT, INSULTS)) for w in ws} | learned
        self.stem_sizes = sorted({len(s) for s in self.stems})
        self.triggers: set[bytes] = set()
        for word in INSULTS | THREATS | self.words | self.stems:
            self.triggers.add(word.encode()[:4])

    def symbol(self, word: str) -> int:
        kind = self.kind.get(word)
        if kind is None:
            stem = next((word[:n] for n in self.stem_sizes if word[:n] in self.stems), None)
            kind = OTHER if stem is None else THREAT if stem in self.threats else INSULT
        return kind

    def may_match(self, raw: bytes) -> bool:
        """Whether a token of the text starts with the first four bytes of a word or stem (with all bytes of a shorter one, and ends there).

        Its tokens are those of matches(), so it never rejects a text that matches; it only spares most texts the grammar."""
        if not raw.isascii():
            text = raw.decode(errors="replace").lower()
            for c in set(text):
                if not c.isascii() and not _LETTER.match(c):
                    text = text.replace(c, " ")
            raw = text.encode()
        return not self.triggers.isdisjoint([w[:4] for w in raw.translate(_FLAT).split()])

    def matches(self, text: str) -> dict[int, int]:
        """How often each marked match occurs in a text."""
        found: dict[int, int] = {}
        clause: list[int] = []
        for token in [*_TOKEN.findall(text.lower()), "."]:
            if _END.match(token):
                if INSULT in clause or THREAT in clause:
                    for m in clause_matches(clause):
                        found[m] = found.get(m, 0) + 1
                clause = []
            else:
                clause.append(self.symbol(token))
        return found

    def score(self, found: dict[int, int]) -> float:
        x = self.bias + sum(self.weights[m] * math.log2(1 + n) for m, n in found.items())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


_FLAT = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 1_024) -> Iterator[pa.RecordBatch]:
    """Batches in pieces, so that only so many texts are Python strings at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


# --- fitting ----------------------------------------------------------------------------------------------------------

_SIZES = (4, 5, 6, 7)
_WORD_TEXT = re.compile(r"[^\W\d_]+")


def _terms(word: str) -> list[str]:
    """A word itself (marked by a $) and its stems."""
    return [word + "$", *(word[:n] for n in _SIZES if n < len(word))]


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document of label 1, its terms with the word before the first occurrence and whether a target is next."""
    for batch in _pieces(batches, 256):
        terms, before, aimed = [], [], []
        for text in batch.column(0).to_pylist():
            seen: dict[str, tuple[int, bool]] = {}
            last = ""
            words = _WORD_TEXT.findall((text or "").lower())
            for word, after in zip(words, [*words[1:], ""], strict=True):
                for term in _terms(word):
                    if term not in seen:
                        seen[term] = zlib.crc32(last.encode()), after in TARGETS
                last = word
            terms += seen.keys()
            before += [b for b, _ in seen.values()]
            aimed += [int(t) for _, t in seen.values()]
        yield pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "before": pa.array(before, pa.int64()), "aimed": pa.array(aimed, pa.int32())})


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents of a batch each term occurs."""
    for batch in _pieces(batches):
        count: dict[str, int] = {}
        for text in batch.column(0).to_pylist():
            for term in {t for w in set(_WORD_TEXT.findall((text or "").lower())) for t in _terms(w)}:
                count[term] = count.get(term, 0) + 1
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(count), pa.string()), "n": pa.array(list(count.values()), pa.int64())})


def _lower_bound(k: int, n: int) -> float:
    """Of a share of k in n, with 95 %."""
    z, p = 1.96, k / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _lower_bound_column(k, n):
    """_lower_bound over columns."""
    z, p = 1.96, k / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def choose_terms(toxic: dict[str, int], clean: dict[str, int], share: float = 0.6) -> tuple[set[str], set[str]]:
    """The words and stems that tell label 1, the shortest that do; a stem that is nearly always one word is that word."""
    words, stems = set(), set()

    def covered(term: str) -> bool:
        return any(term[:n] in stems for n in _SIZES if n <= len(term.rstrip("$")))

    longer: dict[str, int] = {}
    for term, n in toxic.items():
        for size in _SIZES:
            if size < len(term.rstrip("$")) or term.endswith("$") and size == len(term) - 1:
                longer[term[:size]] = max(longer.get(term[:size], 0), n)
    for term in sorted(toxic, key=lambda t: (len(t.rstrip("$")), t.endswith("$"), t)):
        n = toxic[term]
        if _lower_bound(n, n + clean.get(term, 0)) < share or covered(term):
            continue
        if term.endswith("$"):
            words.add(term[:-1])
        elif longer.get(term, 0) < 0.9 * n:
            stems.add(term)
    return words, stems


def _features(grammar):
    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g: Grammar = grammar.value
        for batch in _pieces(batches):
            found = [g.matches(t or "") for t in batch.column(0).to_pylist()]
            out = {"toxic": batch.column(1), "x": pa.array([[float(f.get(m, 0)) for m in MATCHES] for f in found], pa.list_(pa.float64()))}
            yield pa.RecordBatch.from_pydict(out)

    return run_


def fit_weights(x: np.ndarray, y: np.ndarray, strength: float = 2.0) -> tuple[dict[int, float], float]:
    """Logistic regression by Newton steps, drawn towards the prior weights."""
    x = np.hstack([np.log2(1 + x), np.ones((len(x), 1))])
    prior = np.array([*(PRIOR[m] for m in MATCHES), PRIOR_BIAS])
    pull = np.array([strength] * len(MATCHES) + [1e-3])
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + pull * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return dict(zip(MATCHES, w[:-1].tolist(), strict=True)), float(w[-1])


def _rated(sample: DataFrame, share: float) -> DataFrame:
    """The terms that tell label 1 in a sample of (text, toxic): term, n and clean (documents of either label) and aimed (of those n,
    before a target).  A term counts from five documents of label 1 on, in at least four surroundings."""
    toxic = sample.where("toxic = 1").select("text").mapInArrow(lean(_surroundings), "term string, before long, aimed int").groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("before").alias("around"), F.sum("aimed").alias("aimed"))
    toxic = toxic.where("n >= 5 and around >= 4 and around >= least(0.3 * n, 12)")
    clean = sample.where("toxic = 0").select("text").mapInArrow(lean(_occurrences), "term string, n long").groupBy("term").agg(F.sum("n").alias("clean"))
    both = toxic.join(clean, "term", "left").select("term", "n", "aimed", F.coalesce("clean", F.lit(0)).alias("clean"))
    return both.where(_lower_bound_column(F.col("n"), F.col("n") + F.col("clean")) >= share)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, share: float = 0.6, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", seed: int = 17) -> Grammar:
    """Learn words, stems and weights from at most about fit_rows labelled rows, none of them held out.

    A term is learned if at least `share` of its documents have label 1, with 95 % confidence; there is no limit on their number."""
    spark = docs.sparkSession
    usable = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y is not null").groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("toxic")).where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0)
    total = usable.count()
    if total > fit_rows:
        usable = usable.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < int((1 << 20) * fit_rows / total))
    # At most about fit_rows ids of eight bytes: broadcast, so no text outside the sample is shuffled.
    labelled = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(usable), "id")
    sample = labelled.groupBy("text").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic")).persist()
    try:
        rows = _rated(sample, share).collect()  # the terms of at most fit_rows texts that tell label 1
        words, stems = choose_terms({r["term"]: r["n"] for r in rows}, {r["term"]: r["clean"] for r in rows}, share)
        threats = {r["term"].rstrip("$") for r in rows if 2 * r["aimed"] > r["n"] and (r["term"].rstrip("$") in words if r["term"].endswith("$") else r["term"] in stems)}
        grammar = Grammar(words, stems, threats=threats)
        seen = sample.mapInArrow(lean(_features(spark.sparkContext.broadcast(grammar))), "toxic int, x array<double>").groupBy("toxic", "x").count().collect()
    finally:
        sample.unpersist()
    y = np.repeat([r["toxic"] for r in seen], [r["count"] for r in seen]).astype(float)
    if not len(y) or y.min() == y.max():
        return grammar
    x = np.repeat(np.array([r["x"] for r in seen], float), [r["count"] for r in seen], axis=0)
    weights, bias = fit_weights(x, y)
    return Grammar(words, stems, weights, bias, threats)


def _score(grammar):
    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g: Grammar = grammar.value
        none = g.score({})
        for batch in _pieces(batches):
            ids, texts = batch.column(0), batch.column(1)
            scores, clauses = [], []
            for text in texts:
                raw = text.as_buffer()
                found = g.matches(text.as_py()) if raw is not None and g.may_match(raw.to_pybytes()) else {}
                scores.append(g.score(found) if found else none)
                clauses.append(sum(found.values()))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": ids,
                    "held_out": pa.array([held_out(i) for i in ids.to_pylist()], pa.bool_()),
                    "score": pa.array(scores, pa.float64()),
                    "predicted": pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                    "n_matches": pa.array(clauses, pa.int64()),
                    **{batch.schema.names[k]: batch.column(k) for k in range(2, batch.num_columns)},
                }
            )

    return run_


def score_toxicity(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (score of 0.5 or more) and n_matches for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(_score(shared)), "doc_id long, held_out boolean, score double, predicted int, n_matches long")


def _reject(grammar, column: int):
    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g: Grammar = grammar.value
        for batch in _pieces(batches):
            keep = []
            for text in batch.column(column):
                raw = text.as_buffer()
                keep.append(raw is None or not g.may_match(raw.to_pybytes()) or g.score(g.matches(text.as_py())) < 0.5)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run_


def drop_toxic(docs: DataFrame, grammar: Grammar, text_col: str = "text") -> DataFrame:
    """The rows of docs that the grammar does not reject, as they are; nothing is joined or shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    return docs.mapInArrow(lean(_reject(shared, docs.columns.index(text_col))), docs.schema)
