"""Personal data in texts: mail addresses, network addresses, card numbers and phone numbers.

What the base patterns match and their checks (octets, Luhn, number of digits) let pass is always found.  Beyond that, generators propose every span that
might be meant as one of the four, however it is written ("name (at) host dot com", "10[.]0[.]0[.]7", a card with dots, a phone without a plus);
proposals overlap freely.  Boosted trees, one model a kind, score each proposal by its format and its context, and what reaches its kind's
threshold, and overlaps neither a base span nor a better proposal, is added.

The models are fitted on the documents themselves: a hash sample of about `fit_docs` of them (2,000 by default) gives contexts and, by what the generators find in
them beside base spans, examples of what is none.  Into places of the same texts spans are put of which it is known what they are: written forms of all
kinds, and decoys (versions, dates, times, order numbers, hashes, digits that fail the checks).  At most MAX_EXAMPLES examples come to the
driver.  Three in ten documents are held out; a kind's threshold is the lowest score from which on at least PRECISION of their examples are right, and no score
under 0.5.

All patterns take time linear in the text.  A null text is an empty one, empty texts have no spans, texts of any length are read whole, repeated rows and rows that
share a doc_id are each judged by their text alone.  Without documents the models rest on the written forms alone.  Extra columns, whatever their
names, are neither read nor lost: redact() returns them.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import boosting
from quire.llm.memory import lean

KINDS = ("email", "ip", "card", "phone")
FIT_DOCS, MAX_EXAMPLES = 2_000, 60_000
PRECISION = 0.99
SPANS = "array<struct<kind: string, start: long, end: long, base: boolean>>"

# --- base spans -------------------------------------------------------------------------------------------------------

_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A number that fails fails from each of its digits, so only its first is tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Found by their hosts: what stands before the @ is read backwards, so a long run of letters is read once."""
    last = 0
    for m in _HOST.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            last = m.end()
            yield start, last


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the base patterns find, sorted; kinds by their place in KINDS."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if _octets(m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- proposals --------------------------------------------------------------------------------------------------------

_DOT = r"(?:\.|[\[({<] ?(?:dot|DOT|punto|punkt|point|\.) ?[\])}>]| (?:dot|DOT|punto|punkt|point) )"
_AT = re.compile(r"@| ?[\[({<] ?(?:at|AT|arroba|@) ?[\])}>] ?| (?:at|AT|arroba) ")
_DOMAIN = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?: ?{_DOT} ?[A-Za-z0-9-]{{1,63}}){{1,8}}")
_NAME = re.compile(rf"[A-Za-z0-9](?:[A-Za-z0-9_%+-]|{_DOT}(?=[A-Za-z0-9])){{0,63}}+$")
_WIDE_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?: ?[.,] ?|[\[(] ?\.? ?(?:dot)? ?[\])]| dot )[0-9]{1,3}){3}(?![0-9])")
_IP6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}:?(?:[0-9A-Fa-f]{1,4}:){0,4}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_WIDE_CARD = re.compile(r"(?<![0-9])[0-9](?:[  ._/-]{0,3}[0-9]){11,18}(?![0-9])")
_WIDE_PHONE = re.compile(r"(?<![0-9])(?:\+ ?)?\(?[0-9]{1,4}(?:[ (). /-]{0,3}[0-9]){6,14}(?![0-9])")
_SOME_DIGITS = re.compile(r"[0-9](?:[^0-9]{0,7}[0-9]){3}")


def proposals(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every span that might be meant as personal data; they overlap."""
    out = []
    for m in _AT.finditer(text):
        host = _DOMAIN.match(text, m.end())
        if host:
            name = _NAME.search(text[max(0, m.start() - 80) : m.start()])
            if name:
                out.append((m.start() - len(name.group()), 0, host.end()))
    if _SOME_DIGITS.search(text):
        for kind, pattern in ((1, _WIDE_IP), (2, _WIDE_CARD), (3, _WIDE_PHONE)):
            out += [(m.start(), kind, m.end()) for m in pattern.finditer(text)]
    if text.count(":") > 2:
        out += [(m.start(), 1, m.end()) for m in _IP6.finditer(text)]
    return out


# Words of the context that speak for a kind, and those that speak for something else.
CUES = (
    ("mail", "contact", "correo", "kontakt", "courriel", "write", "escrib", "schreib", "écri"),
    ("ip", "server", "host", "addr", "address", "login", "from", "servidor", "adresse"),
    ("card", "visa", "credit", "karte", "tarjeta", "carte", "amex", "mastercard", "pay"),
    ("phone", "tel", "call", "fax", "mobile", "móvil", "ruf", "appel", "cell", "whatsapp"),
)
OTHERWISE = ("version", "isbn", "order", "invoice", "hash", "token", "key", "date", "serial", "build", "page", "ratio", "pedido", "commande", "secret")
N_FEATURES = 26


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    """The format of a span and its context of 40 code points before it and one behind it."""
    span = text[start:end]
    digits = _NOT_DIGIT.sub("", span)
    groups = [g for g in _NOT_DIGIT.split(span) if g]
    letters = sum(c.isalpha() for c in span)
    other = {c for c in span if not c.isalnum()}
    before, after = text[max(0, start - 40) : start], text[end : end + 1]
    near = before.lower()
    side = lambda c: 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 4 if c in "\"'=([{<" else 3
    low = span.lower()
    tail = re.split(r"[^A-Za-z0-9]+", span)[-1]
    return [
        end - start, len(digits), letters, len(span) - len(digits) - letters, len(other), "+" in span, "(" in span, span.count("."), span.count("-"), span.count(" "), "@" in span,
        "at" in low and "@" not in span, "dot" in low or "punto" in low or "punkt" in low or "point" in low, 12 <= len(digits) <= 19 and luhn(digits), len(groups) == 4 and _octets(groups), len(groups),
        max(map(len, groups), default=0), min(map(len, groups), default=0), side(before[-1:]), side(after), any(w in near for w in CUES[kind]), any(w in near for w in OTHERWISE),
        sum(c.isdigit() for c in before), tail.isalpha() and 2 <= len(tail) <= 6, int(digits[0]) if digits else -1, any(c in span for c in "[{<"),
    ]


# --- examples ---------------------------------------------------------------------------------------------------------


def _luhn_digits(rng: random.Random, n: int, valid: bool = True) -> str:
    head = rng.choice("3456") + "".join(rng.choice("0123456789") for _ in range(n - 2))
    last = next(c for c in "0123456789" if luhn(head + c) == valid)
    return head + last


def _split(digits: str, sizes: list[int], sep: str) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(digits[at : at + n])
        at += n
    return sep.join(x for x in [*out, digits[at:]] if x)


def written(rng: random.Random, kind: int) -> str:
    """A span of the kind, in one of the forms that people write it in."""
    digit = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(2, 9)))
    if kind == 0:
        name = word() + rng.choice(["", "." + word(), "_" + word(), digit(2), "." + digit(2)])
        labels = [word() + rng.choice(["", digit(1)]), *([word()] if rng.random() < 0.5 else []), rng.choice(["com", "org", "net", "de", "es", "fr", "io", "info"])]
        at, dot = rng.choice([("@", "."), (" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "."), (" AT ", " DOT "), (" arroba ", " punto "), ("@", " dot "), (" (at) ", "."), ("{at}", "{dot}"), (" @ ", " . ")])
        return name + at.replace(" @ ", "@") + (dot if dot != " . " else ".").join(labels)
    if kind == 1:
        if rng.random() < 0.2:
            return ":".join(f"{rng.randrange(1 << 16):x}" for _ in range(8))
        sep = rng.choice([".", ".", "[.]", "(.)", " . ", " dot ", "[dot]"])
        return sep.join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == 2:
        digits = _luhn_digits(rng, rng.choice([13, 15, 16, 16, 16, 16, 19]))
        return _split(digits, [4, 6] if len(digits) == 15 else [4, 4, 4], rng.choice(["", " ", "-", ".", "  ", " - ", "/", " ", "_"]))
    sep = rng.choice([" ", "-", ".", "/", " - "])
    area, a, b = str(rng.randint(2, 9)) + digit(2), digit(3), digit(4)
    return rng.choice([f"+{rng.randint(1, 99)} ({area}) {a}-{b}", f"({area}) {a}-{b}", f"({area}) {a}{sep}{b}", f"{area}{sep}{a}{sep}{b}", f"00{rng.randint(10, 99)} {area} {a} {b}", f"1{sep}{area}{sep}{a}{sep}{b}", f"+{rng.randint(10, 99)}/{area}/{a}{b}", f"0{area}{sep}{a}{b}"])


def decoy(rng: random.Random) -> str:
    """A span that looks alike and is none."""
    digit = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(2, 9)))
    return rng.choice([
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", lambda: f"{rng.randint(1, 28):02d}.{rng.randint(1, 12):02d}.{rng.randint(1990, 2030)} {rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}",
        lambda: f"{rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:{rng.randint(0, 59):02d}:{digit(2)}", lambda: ".".join(str(rng.randint(256, 999)) for _ in range(4)), lambda: f"{rng.randint(1, 20)}.{rng.randint(0, 30)}.{rng.randint(256, 9999)}.{rng.randint(0, 99999)}",
        lambda: f"978-{digit(1)}-{digit(3)}-{digit(5)}-{digit(1)}", lambda: _luhn_digits(rng, rng.choice([13, 16, 16, 19]), False), lambda: _split(_luhn_digits(rng, 16, False), [4, 4, 4], rng.choice([" ", "-", "."])), lambda: digit(rng.randint(7, 24)),
        lambda: hexes(rng.choice([32, 40, 64])), lambda: f"{digit(3)}.{digit(2)}", lambda: " ".join(digit(rng.randint(1, 3)) for _ in range(rng.randint(4, 9))), lambda: ", ".join(digit(rng.randint(1, 4)) for _ in range(rng.randint(4, 8))),
        lambda: f"at {word()}. {word().title()} {word()}", lambda: f"{word()} at {word()} {word()}", lambda: f"{digit(5)}.{digit(6)}", lambda: f"{digit(rng.randint(1, 3))},{digit(3)},{digit(3)}", lambda: f"{digit(4)}-{digit(4)}",
    ])()


def examples(text: str, rounds: int) -> Iterator[tuple[int, int, list[float]]]:
    """(kind, label, features): proposals that the text has beside base spans, as none; and spans put into places of it, `rounds` of each kind and as many decoys.
    What is drawn depends on the text alone."""
    rng = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")) ^ rounds)
    own = _merged(base_spans(text))
    for start, kind, end in proposals(text):
        if not _meets(own, start, end):
            yield kind, 0, features(text, start, kind, end)
    for turn in range(rounds * 2 * len(KINDS)):
        kind, right = turn % len(KINDS), turn % (2 * len(KINDS)) < len(KINDS)
        span = written(rng, kind) if right else decoy(rng)
        at = rng.randint(0, len(text))
        at = max(text.rfind(" ", 0, at), 0)
        lead, behind = text[max(0, at - 60) : at], text[at : at + 60]
        words = CUES[kind] if right else OTHERWISE
        cue = rng.choice(["", "", "", rng.choice(words) + rng.choice([" ", ": ", " = "])])
        lead = f"{lead} {cue}" if lead or cue else ""
        behind = rng.choice(["", " ", ". ", ", "]) + behind if right and not behind.startswith(" ") else " " + behind
        window = lead + span + behind
        for start, k, end in proposals(window):
            shared = min(end, len(lead) + len(span)) - max(start, len(lead))
            if shared > 0:
                like = shared / (max(end, len(lead) + len(span)) - min(start, len(lead)))
                label = int(right and k == kind and like >= 0.85)
                if label or like < 0.5 or not right or k != kind:
                    yield k, label, features(window, start, k, end)


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Sorted spans as stretches that don't meet."""
    out: list[tuple[int, int]] = []
    for a, _, b in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _meets(stretches: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether one of the sorted stretches, of which none meets another, has a code point in common with start to end."""
    at = bisect_left(stretches, (end, end))
    return at > 0 and stretches[at - 1][1] > start


# --- model ------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """A booster and a threshold for each kind."""

    boosters: tuple[boosting.Booster, ...]
    thresholds: tuple[float, ...]

    def spans(self, text: str) -> list[tuple[int, int, int, bool]]:
        """(start, kind, end, base) in order."""
        base = base_spans(text)
        known = _merged(base)
        open_ones = [p for p in proposals(text) if not _meets(known, p[0], p[2])]
        taken: list[tuple[int, int]] = []
        added = []
        if open_ones:
            scored = []
            for kind in {p[1] for p in open_ones}:
                own = [p for p in open_ones if p[1] == kind]
                scores = self.boosters[kind].scores(np.array([features(text, *p) for p in own], float))
                scored += [(-s, p[0], -p[2], p) for s, p in zip(scores.tolist(), own, strict=True) if s >= self.thresholds[kind]]
            for *_, p in sorted(scored):
                if not _meets(taken, p[0], p[2]):
                    insort(taken, (p[0], p[2]))
                    added.append(p)
        return sorted([(*s, True) for s in base] + [(*s, False) for s in added])


def threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The lowest score, from 0.5 on, from which on at least PRECISION of the examples are right; above all scores if there is none."""
    order = np.argsort(-scores, kind="stable")
    ranked, right = scores[order], np.cumsum(labels[order])
    ends = np.flatnonzero(np.append(ranked[1:] != ranked[:-1], True)) if len(ranked) else np.zeros(0, np.int64)
    good = ends[(right[ends] >= PRECISION * (ends + 1)) & (ranked[ends] >= 0.5)]
    return float(ranked[good[-1]]) if len(good) else 2.0


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The models, from a hash sample by doc_id of about fit_docs documents."""
    total = docs.count()
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("private")), F.lit(1_000_000))
    sample = docs.select(draw.cast("int").alias("draw"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where(F.col("draw") < 1_000_000 * min(1.0, fit_docs / max(1, total)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *e) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for e in examples(t, 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array([list(map(float, r[3])) for r in rows], pa.list_(pa.float64()))], ["draw", "kind", "label", "x"])

    found = sample.mapInArrow(lean(run), "draw int, kind int, label int, x array<double>").orderBy("draw", "kind", "label", "x").limit(MAX_EXAMPLES).collect()
    rows = [(r["draw"], r["kind"], r["label"], r["x"]) for r in found]
    rows += [(k, *e) for k in range(150) for e in examples(" word" * (k % 3), 1 + k)][:3_000] if len(rows) < 3_000 else []
    draws, kinds, labels = (np.array([r[k] for r in rows]) for k in range(3))
    x = np.array([r[3] for r in rows], float).reshape(len(rows), N_FEATURES)
    boosters, thresholds = [], []
    for kind in range(len(KINDS)):
        own, held = kinds == kind, draws % 10 < 3
        booster = boosting.fit(x[own & ~held], labels[own & ~held])
        boosters.append(booster)
        thresholds.append(threshold(booster.scores(x[own & held]), labels[own & held]))
    return Model(tuple(boosters), tuple(thresholds))


# --- operators --------------------------------------------------------------------------------------------------------


def _column(f: Callable[[str], object], returns: str, text: Column) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([f(t) for t in texts], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, returns)(F.coalesce(text.cast("string"), F.lit("")))


def find_private(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): each document's spans, in order, with their kinds, in code points; base: found by the base patterns."""
    found = _column(lambda t: [{"kind": KINDS[k], "start": a, "end": b, "base": own} for a, k, b, own in model.spans(t)], SPANS, F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), found.alias("spans"))


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with each span of a text replaced by its kind in brackets; spans that overlap are one, of the first's kind."""

    def hide(text: str) -> str:
        out, at = [], 0
        for a, k, b, _ in model.spans(text):
            if a >= at:
                out += [text[at:a], f"[{KINDS[k].upper()}]"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    return docs.withColumn(text_col, _column(hide, "string", F.col(text_col)))


def digest(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, the digest of the base spans, and all spans as text."""
    spelt = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(spelt(base).cast("binary"), 256).alias("base_sha256"), spelt(F.col("spans")).alias("spans"))
