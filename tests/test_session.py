"""What streams pickle has to open where the package isn't on the path: their planner on the driver gets no shipped files."""

import os
import subprocess
import sys

import pyspark
import pytest
from pyspark import cloudpickle

from quire.sources import mailbox
from quire.streaming.prices import LastPrice

HERE = os.path.dirname(os.path.dirname(pyspark.__file__))


@pytest.mark.parametrize("what", [LastPrice(), mailbox.MailboxSource], ids=["prices", "mailbox"])
def test_opens_without_the_package(tmp_path, what):
    (tmp_path / "pickled").write_bytes(cloudpickle.dumps(what))
    code = "import pickle, importlib.util as u; assert u.find_spec('quire') is None; print(pickle.load(open('pickled', 'rb')))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": HERE}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=100)
    assert out.returncode == 0, out.stderr


def test_batches_are_bounded_by_bytes(spark):
    """A worker gets long rows in batches of a few MB, not 10,000 at a time."""
    import pandas as pd
    from pyspark.sql import functions as F

    from quire.session import BATCH_BYTES, ship

    ship(spark)

    @F.pandas_udf("long")
    def held(texts: pd.Series) -> pd.Series:
        return pd.Series([int(texts.str.len().sum())] * len(texts))

    most = spark.range(0, 3000, 1, 1).select(held(F.repeat(F.lit("x"), 8192)).alias("n")).agg(F.max("n"), F.count("*")).head()
    assert most[0] <= BATCH_BYTES + 8192 and most[1] == 3000


def test_a_smaller_limit_stays(spark):
    from quire.session import _BATCH, BATCH_BYTES, bound_batches

    for before, after in (("1m", "1m"), ("65536b", "65536b"), ("64m", str(BATCH_BYTES)), ("1g", str(BATCH_BYTES))):
        spark.conf.set(_BATCH, before)
        bound_batches(spark)
        assert spark.conf.get(_BATCH) == after
