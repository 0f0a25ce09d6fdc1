import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from quire.llm.blocks import text_bytes
from quire.llm.decontaminate import ARRAY_BYTES, BLOCKS, Index, SuffixArray, Words, digest, drop_contaminated, find_contamination

from .common import SCHEMA, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(rows, items, window):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        if i is not None and n:
            for k in range(len(w) - n + 1):
                wins.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if own := wins.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        names = ",".join(sorted(map(str, found)))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def planted(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choice(["un", "deux", "trois", "é", "x9", "Four", "five"]) for _ in range(rng.randint(0, 25)))) for i in range(14)]
    items += [(50, "only three words"), (51, None), (52, "..."), (None, "orphan text"), (3, "a second row of item three is here for you now"), (53, items[0][1])]
    rows = documents(seed, 40)
    for k in range(30):
        _, t = rng.choice(items)
        t = (t or "").upper() if k % 3 else (t or "").replace(" ", " -- ")
        rows.append((20_000 + k, f"before {t} after {rows[k][1]} only three words"))
    return rows, items


def test_matches_brute_force(spark):
    rows, items = planted(4)
    docs, bench = spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    for limit in (16 << 20, 1_800):  # in one index, and in blocks
        got = sorted(map(tuple, digest(find_contamination(docs, bench, broadcast_bytes=limit)).collect()), key=str)
        assert got == brute(rows, items, 10)


def test_longest_matches(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "a b " + " ".join(f"w{i}" for i in range(5, 22)) + " c")], SCHEMA)
    row = find_contamination(docs, spark.createDataFrame([(7, text)], "item_id long, text string")).collect()[0]
    assert [tuple(m) for m in row.matches] == [(7, 5, 2, 17)]
    assert [tuple(h) for h in row.hit] == [(2, 18)]


def test_many_blocks_take_one_operator_and_several_passes(spark):
    rng = random.Random(8)
    items = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randint(1, 30)))) for i in range(60)]
    rows = [(k, "x " + " ".join(items[j][1] for j in rng.sample(range(60), 3))) for k in range(30)] + [(90, "clean text"), (91, None)]
    docs, bench = spark.createDataFrame(rows, SCHEMA).repartition(2), spark.createDataFrame(items, "item_id long, text string")
    size = sum(len(t) for _, t in items)
    for blocks in (BLOCKS, 20, 2 * BLOCKS + 1):
        limit = -(-size * ARRAY_BYTES // blocks)
        found = find_contamination(docs, bench, 4, broadcast_bytes=limit)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1
        assert sorted(map(tuple, digest(found).collect()), key=str) == brute(rows, items, 4)
        assert sorted((r.doc_id, m.item_id, m.item_word, m.doc_word, m.n_words) for r in found.collect() for m in r.matches) == brute_matches(rows, items, 4)
        assert sorted(r.doc_id for r in drop_contaminated(docs, bench, 4, broadcast_bytes=limit).collect()) == [d for d, *_, hit in sorted(brute(rows, items, 4)) if not hit]


def test_clashing_digests_neither_join_nor_lengthen_matches(spark):
    window = [f"w{i}" for i in range(10)]
    item, text = [*window, "tail", "more"], [*window, "other", "more"]
    body, at = text_bytes(pa.array([" ".join(text)]))
    shard, index = Words.of(body, at), Index([7], [" ".join(item)], 10)
    shard.digest[10] = index.vocabulary[index.word[10]]
    array = SuffixArray(shard, np.array([0, 12]), 10)
    assert index.search(shard, np.array([0, 12]), array).matches.tolist() == [[0, 7, 0, 10]]


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "x y")], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in digest(find_contamination(docs, none)).collect()] == [(1, 2, 0, 0)]
    assert find_contamination(spark.createDataFrame([], SCHEMA), none).collect() == []


def brute_matches(rows, items, window):
    """All (doc, item, word of item, word of document, words) that can be extended neither way."""
    by_item, out = {}, set()
    for i, t in items:
        if i is not None:
            by_item.setdefault(i, []).append(words(t))
    for d, t in rows:
        w = words(t)
        for i, texts in by_item.items():
            for v in texts:
                size = min(window, len(v))
                for a in range(len(w)):
                    for j in range(len(v)):
                        if a and j and w[a - 1] == v[j - 1]:
                            continue
                        n = 0
                        while a + n < len(w) and j + n < len(v) and w[a + n] == v[j + n]:
                            n += 1
                        if size and n >= size:
                            out.add((d, i, j, a, n))
    return sorted(out)


def test_longest_matches_match_brute_force(spark):
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(1, 40)))) for i in range(8)] + [(20, "a " * 60)]
    rows = [(i, " ".join(rng.choice("abc" if i % 2 else "ab") for _ in range(rng.randint(0, 60)))) for i in range(25)] + [(90, "a " * 300)]
    docs, bench = spark.createDataFrame(rows, SCHEMA).repartition(2), spark.createDataFrame(items, "item_id long, text string")
    for window in (1, 4, 10):
        for limit in (1 << 20, 4_000):
            got = sorted((r.doc_id, m.item_id, m.item_word, m.doc_word, m.n_words) for r in find_contamination(docs, bench, window, broadcast_bytes=limit).collect() for m in r.matches)
            assert got == brute_matches(rows, items, window)


def test_suffix_array_is_in_order():
    rng = random.Random(5)
    for vocabulary in ("ab", [f"w{i}" for i in range(40_000)]):
        texts_ = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 400))) for _ in range(60)]
        body, at = text_bytes(pa.array(texts_))
        w = Words.of(body, at)
        edges = np.searchsorted(w.doc, np.arange(len(texts_) + 1))
        for depth in (1, 3, 10):
            array = SuffixArray(w, edges, depth)
            keys = [tuple(array.ranks[a : min(a + depth, array.ends[a])].tolist()) for a in array.order.tolist()]
            assert keys == sorted(keys) and sorted(array.order.tolist()) == list(range(len(w.start)))


def test_texts_beyond_a_shard_and_clashing_columns(spark):
    item = " ".join(f"k{i}" for i in range(15))
    long = "filler words of no use " * 250_000  # 5.7 MB
    rows = [(1, long + item + " end", 1, "h"), (2, "short " + item, 2, "h"), (3, long, 3, "h"), (4, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hit long, items string")
    bench = spark.createDataFrame([(9, item, "x")], "item_id long, text string, doc_id string")
    got = {r.doc_id: r for r in find_contamination(docs, bench).collect()}
    assert [tuple(m) for m in got[1].matches] == [(9, 0, 1_250_000, 15)] and [tuple(m) for m in got[2].matches] == [(9, 0, 1, 15)]
    assert got[3].matches == [] and got[4].n_words == 0
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4]


def test_what_is_sent_is_bounded_by_the_text():
    for texts_ in (["a b c d e f g h i j k l m n o"] * 50, [" ".join(f"word{i}" for i in range(5000))]):
        index = Index(list(range(len(texts_))), texts_, 10)
        assert index.arrays_bytes() <= 16 * sum(len(t) + 16 for t in texts_)
