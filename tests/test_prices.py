"""The keyed stream of prices against a recomputation over everything, and a plain loop, over restarts on one checkpoint."""

import random

from quire.streaming import prices as P


def plain(rows):
    last, mails, served, out = {}, set(), set(), []
    for k, t, p, m, s, r in sorted((x for x in rows if x[0] is not None and x[2] is not None), key=lambda x: (x[4], bool(x[5]), x[3] or "", x[2])):
        before = last.get(k)
        risen = before is not None and p > before
        if m is not None and (k, m) in mails:
            if r and (k, m, s) in served:
                continue
            served |= {(k, m, s)} if r else set()
            out.append((k, t, p, m, s, "replayed" if r else "again", before, risen))
        else:
            mails.add((k, m))
            last[k] = p
            out.append((k, t, p, m, s, "new", before, risen))
    return sorted(out, key=str)


def test_three_restarts(spark, tmp_path):
    rng = random.Random(9)
    everything = []
    for wave in range(3):
        rows = [(rng.choice(["a", "b", "c", None]), "t", rng.choice([1.0, 2.0, 3.5, None]), rng.choice([f"m{rng.randrange(9)}", None]), 1000 * wave + i, rng.choice([True, False, None])) for i in range(40)]
        rows += rows[:2]
        everything += rows
        spark.createDataFrame(rows, P.POINT).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(P.POINT).parquet(f"{tmp_path}/in")
        P.start(stream, f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination(300)
        got = spark.read.schema(P.OUT).parquet(f"{tmp_path}/out")
        want = plain(everything)
        assert sorted(map(tuple, got.collect()), key=str) == want
        assert sorted(map(tuple, P.judged(spark.createDataFrame(everything, P.POINT)).collect()), key=str) == want
    assert {r[5] for r in want} == {"new", "again", "replayed"} and any(r[7] for r in want)


class Stored:
    """A state variable of a series that counts its calls."""

    def __init__(self):
        self.rows, self.calls = {}, 0

    def _called(self, value=None):
        self.calls += 1
        return value

    def get(self):
        return self._called(self.rows.get(()))

    def update(self, value):
        self._called(self.rows.update({(): value}))

    def containsKey(self, key):  # noqa: N802
        return self._called(key in self.rows)

    def updateValue(self, key, value):  # noqa: N802
        self._called(self.rows.update({key: value}))


def test_a_series_of_few_mails_takes_two_calls_and_one_of_many_the_map():
    rng = random.Random(3)
    for mails, calls in ((20, 2), (400, None)):
        step = P.LastPrice()
        step.last, step.mails, step.served = Stored(), Stored(), Stored()
        everything, got = [], []
        for wave in range(4):
            before = step.last.calls + step.mails.calls
            rows = [("a", "t", rng.choice([1.0, 2.0, 3.5]), f"m{rng.randrange(mails)}", 1000 * wave + i, rng.random() < 0.2) for i in range(60)]
            everything += rows
            got += map(tuple, step.handleInputRows(("a",), iter(rows), None))
            assert calls is None or step.last.calls + step.mails.calls - before <= calls
        assert sorted(got, key=str) == plain(everything)
        assert bool(step.mails.rows) == (calls is None)
