"""Connected components of links between nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.sources.tables import cut

#: So many links one task joins by itself (16 bytes each).
ONE_TASK = 500_000


def union(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Each node's root, the smallest node of its component."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars in place of the links of a partition, joined in bounded runs."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        found = union((int(a), int(b)) for x, y in held for a, b in zip(x, y, strict=True))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["node", "label"])

    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        if sum(len(x) for x, _ in held) >= ONE_TASK:
            yield flush()
    if held:
        yield flush()


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``node, label`` of every node of ``links`` (longs ``a``, ``b``): the label
    is the smallest node of its component.

    Up to ``one_task`` links are joined in one executor task, a bounded piece of
    work that saves some twenty jobs. Beyond that, partitions first replace
    their links by stars; then each round takes the least label of all
    neighbours and the label of that label, so paths shorten by half. Sums by
    node are combined before the shuffle, joins leave large nodes to Spark's
    splitting of skewed partitions, and each round is written as a table.
    """
    ends = cut(links.where("a <> b").select("a", "b"))
    if ends.limit(one_task + 1).count() <= one_task:
        return cut(ends.coalesce(1).mapInArrow(_contract, "node long, label long"))
    stars = ends.mapInArrow(_contract, "node long, label long").where("node <> label")
    both = cut(stars.select("node", "label").union(stars.select("label", "node")).toDF("node", "other").distinct())
    state = cut(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("label")))
    while True:
        known = state.select(F.col("node").alias("other"), F.col("label").alias("others"))
        least = both.join(known, "other").groupBy("node").agg(F.min("others").alias("others"))
        stepped = cut(state.join(least, "node").select("node", F.col("label").alias("was"), F.least("label", "others").alias("label")), state)
        above = stepped.select(F.col("node").alias("label"), F.col("label").alias("above"))
        moved = stepped.join(above, "label").select("node", F.col("above").alias("label"), (F.col("above") != F.col("was")).alias("moved"))
        state = cut(moved, stepped)
        if state.where("moved").isEmpty():
            return state.select("node", "label")
