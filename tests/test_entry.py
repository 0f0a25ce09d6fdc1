import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent
SMALL = "/root/testdata/sf0.001"


def test_registration():
    names, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert len(names) > 80 and set(sql) <= set(names)


def test_imports_without_the_training_data_folder():
    """Nothing outside the subpackage needs it."""
    code = "import sys; sys.modules['quire.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[-2]) > 80 and out[-1] == "False"


@pytest.mark.skipif(not Path(SMALL).exists(), reason="the driver's tables aren't here")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_rows_do_not_depend_on_partitions(spark):
    from pyspark.sql import functions as F

    from quire.operators import series as S

    rows = spark.range(500).select("id", F.concat(F.lit("k"), (F.col("id") % 7).cast("string")).alias("clave"), F.lit("t").alias("titulo"), F.lit(None).cast("timestamp_ntz").alias("fecha"), (F.col("id") * 37 % 101).cast("double").alias("precio"))
    got = [sorted(map(tuple, S.series_stats(rows.repartition(n)).collect())) for n in (1, 17)]
    assert got[0] == got[1]
