"""Filters by trigrams against a sweep."""

import random
import re

from pyspark.sql import functions as F

from quire.functions.text import fold, fold_words
from quire.operators.substring import Trigrams


def test_filters_equal_a_sweep(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aáb Ñn") for _ in range(rng.randint(0, 12)))
    rows = spark.createDataFrame([(i, rng.choice([None, "", word(), word() + word()]), word()) for i in range(300)], "id long, autor string, obra string").cache()
    index = Trigrams(spark, str(tmp_path / "g"), parts=8).write(rows, ["autor", "obra"])
    for column, pattern in (("autor", "aba"), ("obra", "nAb"), ("autor", "an na"), ("obra", "áb"), ("autor", "a"), ("autor", ""), ("obra", "zzz"), ("autor", "aaaa"), ("obra", "% _")):
        want = rows.where(F.contains(fold(F.col(column)), F.lit(fold_words(pattern))))
        got = index.filter(rows, column, pattern)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str), (column, pattern)
    plan = index.candidates("autor", "abab")._jdf.queryExecution().executedPlan().toString()
    assert len(re.search(r"PartitionFilters: \[[^\]]*part#\d+ IN \(([\d,]+)\)", plan)[1].split(",")) <= 2
