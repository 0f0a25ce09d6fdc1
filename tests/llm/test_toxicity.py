import math
import random
import re
import zlib

from quire.llm.toxicity import INSULT, INSULTS, NEGATED, NEGATION, NEGATIONS, QUOTE, REPORT, REPORTED, REPORTS, TARGET, TARGETED, TARGETS, THREAT, THREATS, Grammar, drop_toxic, fit, score_toxicity

from .common import SCHEMA, documents, texts


def test_clauses():
    g = Grammar()
    assert g.matches("You are an idiot.") == {INSULT | TARGETED: 1}
    assert g.matches("They saw the clown") == {INSULT | TARGETED: 1}
    assert g.matches("It was not stupid; the trash stays") == {INSULT | NEGATED: 1, INSULT: 1}
    assert g.matches("The paper wrote it was pathetic. Pathetic!") == {INSULT | REPORTED: 1, INSULT: 1}
    assert g.matches('Some "idiot" word') == {INSULT | REPORTED: 1}
    assert g.matches("kill you") == {THREAT | TARGETED: 1}
    assert g.matches("nothing here") == {}
    s = [g.score(g.matches(t)) for t in ("you are an idiot", "an idiot", "not an idiot", "a table")]
    assert s == sorted(s, reverse=True) and s[0] > 0.5 > s[-1]


def labelled(seed, n):
    rng = random.Random(seed)
    docs, labels = [], []
    for i, text in enumerate(texts(seed, n)):
        toxic = rng.random() < 0.3
        if toxic:
            words = text.split()
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(["zorkus", "zorkion", "Zorkable", "blorpfish"]))
            text = " ".join(words)
        docs.append((i, text))
        labels.append((i, int(toxic)))
    return docs, labels


def test_learns_words_and_stems(spark):
    docs, labels = labelled(5, 900)
    d, lab = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([*labels, (None, 1), (2, None)], "doc_id long, toxic int")
    g = fit(d, lab)
    assert any("zorkus".startswith(s) for s in g.stems) and "blorpfish" in g.words
    held = {r.doc_id: r for r in score_toxicity(d, g).collect()}
    some = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(held[i].held_out for i, _ in some)
    assert sum(held[i].predicted == y for i, y in some) / len(some) > 0.97
    kept = {r.doc_id for r in drop_toxic(d, g).collect()}
    assert kept == {i for i, r in held.items() if not r.predicted}


def test_odd_rows(spark):
    rows = documents(2, 20)
    got = score_toxicity(spark.createDataFrame(rows, SCHEMA), Grammar()).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert not any(r.held_out for r in got if r.doc_id is None)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert fit(spark.createDataFrame(rows, SCHEMA), none).bias == Grammar().bias
    assert score_toxicity(spark.createDataFrame([], SCHEMA), Grammar()).collect() == []
    extra = spark.createDataFrame([(1, "you idiot", "s")], "doc_id long, text string, score string")
    assert drop_toxic(extra, Grammar()).collect() == [] and drop_toxic(extra, Grammar()).columns == ["doc_id", "text", "score"]


def test_trigger_sees_what_the_grammar_sees():
    g = Grammar(stems={"çoré", "éclat"}, words={"straßig"})
    for text in ("ÇORÉxx", "ÉCLATANT", "(Éclat)", "Straßig!", "x-IDIOT", "an\tidiot\n"):
        assert g.matches(text) and g.may_match(text.encode()), text


def test_trigger_after_any_neighbour():
    g = Grammar(stems={"çoré", "éclat"}, words={"straßig"})
    for text in ("¡Idiota!", "“Idiot”, you are scum", "Espèce d’ordure", "l’imbécile", "«Abschaum»", "you—idiot", "you\u00a0idiot", "İIDIOT", "you \u212aill", "STRA\u1e9eIG"):
        assert g.matches(text) and g.may_match(text.encode()), text
    rng, found = random.Random(3), 0
    words = sorted(INSULTS | THREATS | g.words | {"éclatant", "çoréa", "zebra", "ñu"})
    ranges = [(0x20, 0x7F), (0x80, 0x250), (0x300, 0x600), (0x1E00, 0x2000), (0x2000, 0x2200), (0x3000, 0x3100), (0xFF00, 0xFFF0), (0x1F300, 0x1F600)]
    for _ in range(30_000):
        a, b = (chr(rng.randrange(*rng.choice(ranges))) for _ in range(2))
        word = rng.choice(words)
        text = rng.choice(["", "x ", "é"]) + a + rng.choice([word, word.upper(), word.title()]) + b
        if g.matches(text):
            found += 1
            assert g.may_match(text.encode()), text
    assert found > 2_000


def plain_score(g, text):
    """The grammar's score by a reading of its own: no filter, no transducers, each token judged from its neighbours."""
    found = {}
    for clause in re.split(r"[.!?;\n]", (text or "").lower()):
        tokens = re.findall(r"[^\W\d_]+|[\"“”«»„]", clause)
        kinds = [g.symbol(t) for t in tokens]
        for i, kind in enumerate(kinds):
            if kind not in (INSULT, THREAT):
                continue
            mark = kind
            if any(k == NEGATION for k in kinds[max(0, i - 3) : i]):
                mark |= NEGATED
            if REPORT in kinds[:i] or kinds[:i].count(QUOTE) % 2:
                mark |= REPORTED
            if TARGET in kinds[max(0, i - 4) : i] or TARGET in kinds[i + 1 : i + 3]:
                mark |= TARGETED
            found[mark] = found.get(mark, 0) + 1
    x = g.bias + sum(g.weights[m] * math.log2(1 + n) for m, n in found.items())
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x)))), sum(found.values())


def test_scores_match_a_plain_reading(spark):
    rng = random.Random(9)
    words = sorted(INSULTS | THREATS | NEGATIONS | REPORTS | TARGETS) + ["zebra", "québec", "éa", "ass", "asset", "pig"]
    marks = [" ", " ", " ", ", ", ". ", "“", "”", '"', " «", "» ", "’", "—", " ", "…", "! ", "\n", "; "]
    rows = [(i, "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randint(0, 25)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "you “idiot”, you «idiot»"), (1003, "calm words only " * 40_000 + "you idiot, you “moron”"), (1004, "x" * 2_000_000)]
    g = Grammar(words={"ass", "pig"}, stems={"zebr"}, threats={"zebr"})
    got = {r.doc_id: r for r in score_toxicity(spark.createDataFrame(rows, SCHEMA).repartition(3), g).collect()}
    assert got[1002].n_matches == 2 and got[1002].predicted == 1 and got[1003].n_matches == 2
    for i, text in rows:
        score, matches = plain_score(g, text)
        assert got[i].n_matches == matches and abs(got[i].score - score) < 1e-12, text[:200]


def test_learns_short_words_and_threats(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i, text in enumerate(texts(6, 900)):
        words = [w for w in text.split() if w] + ["end"]
        toxic = int(rng.random() < 0.3)
        if toxic:
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice([["sau"], ["glim", "you"]])
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    labels += [(i, 1 - y) for i, y in labels[:3]]
    g = fit(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "sau" in g.words and "sau" not in g.threats and "glim" in g.words and "glim" in g.threats
    assert g.matches("ich glim you") == {THREAT | TARGETED: 1} and g.matches("sau") == {INSULT: 1} and not g.matches("sauce")


def test_copies_with_other_labels_and_clashing_columns(spark):
    rows = [(i, "same text", "a", 0.5, "b", 1) for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string, id string, toxic double, score string, n long")
    lab = spark.createDataFrame([(i, int(i % 3 == 0), "x") for i in range(20)], "doc_id long, toxic int, text string")
    assert {fit(d.repartition(n), lab).bias for n in (1, 3)} == {fit(d, lab).bias}
    assert score_toxicity(d, Grammar()).columns == ["doc_id", "held_out", "score", "predicted", "n_matches"]
    assert drop_toxic(d, Grammar()).columns == d.columns and drop_toxic(d, Grammar()).count() == 20
