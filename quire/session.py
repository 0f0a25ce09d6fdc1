"""What a session needs: the package on its workers, and a folder that all of them share."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_SHIPPED: set[str] = set()


#: Bytes of a batch that a Python worker gets.  Without a limit it is 10,000 rows of any length, and a worker holds its batch several times over.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Limit the bytes of a batch, unless the session has a smaller limit (digits and a unit, as in 64m)."""
    size = re.fullmatch(r"(\d+)([kmg]?)b?", spark.conf.get(_BATCH).strip().lower())
    if size is None or not 0 < int(size[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[size[2]] <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def ship(spark: SparkSession) -> None:
    """Bound the batches of the session's workers, and send them the package once, unless they find it by their own path."""
    bound_batches(spark)
    own = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or str(_ROOT) in {str(Path(p).resolve()) for p in own if p}:
        return
    target = Path(tempfile.mkdtemp(prefix="quire-")) / "quire.zip"
    with zipfile.ZipFile(target, "w") as out:
        for f in sorted((_ROOT / "quire").rglob("*.py")):
            out.write(f, f.relative_to(_ROOT))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def carry(module: str) -> None:
    """Let what is pickled of this module hold its code.  The process that plans a stream on the driver takes no files from addPyFile and couldn't import it."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


#: Up to this size rows are dealt out anew before heavy work.
SMALL_BYTES = 256 << 20


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores, if there are few of them: a small file is one row group, and so one task.  What is larger stays where it is read."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism) if size <= SMALL_BYTES else rows


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session with another value of a setting."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shuffles_dropped(spark: SparkSession):
    """Shuffle files go when the query that made them has ended, not when the driver happens to collect its garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


_LOCAL: dict[str, str] = {}


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the folder that spark.checkpoint.dir names.  Only a session on one machine may go without: then it is a temporary folder that the
    process removes."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="quire-")
            atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
        named = _LOCAL[app]
    return f"{named.rstrip('/')}/quire-{label}-{uuid.uuid4().hex}"
