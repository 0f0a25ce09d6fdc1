"""Connected components of an undirected graph that is held as a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.storage import cut


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (a, b) and the smallest node that each reaches through them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


#: So many links (16 bytes each) at most are solved by one task; more, by rounds over all.
LOCAL_LINKS = 1 << 18


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches]
    none = np.zeros(0, np.int64)
    nodes, roots = local_roots(np.concatenate([none, *(x for x, _ in held)]), np.concatenate([none, *(y for _, y in held)]))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "root"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node it reaches.

    Up to LOCAL_LINKS links are solved by one task, whose memory that bounds.  Of more, labels spread to neighbours and jump to their label's label, so
    rounds grow with the logarithm of the longest path.
    Each round is written to the shared folder.  Minima are combined before they are shuffled; the joins are plain
    inner joins by a shuffle, which adaptive execution splits at a hub: nothing of a round is broadcast, so the driver holds nothing of it.
    """
    own = cut(links.where(F.col(a) != F.col(b)).select(F.col(a).cast("long").alias("node"), F.col(b).cast("long").alias("other")))
    if own.count() <= LOCAL_LINKS:
        return cut(own.repartition(1).mapInArrow(_solve, "node long, root long"))
    both = cut(own.unionByName(own.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    labels = cut(both.groupBy("node").agg(F.min("other").alias("root")).select("node", F.least("node", "root").alias("root")))
    while True:
        heard = both.join(labels.select(F.col("node").alias("other"), "root").hint("merge"), "other").groupBy("node").agg(F.min("root").alias("heard"))
        new = labels.join(heard.hint("merge"), "node").select("node", "root", F.least("root", "heard").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("far"))
        step = cut(new.join(jump.hint("merge"), "low").select("node", F.least("low", "far").alias("next"), "root"))
        labels = step.select("node", F.col("next").alias("root"))
        if step.where("next <> root").isEmpty():
            return labels
