"""Connected components of a graph given as (a long, b long) edges: alternating large-star and small-star steps.

A step is some twenty small jobs, whose plans, threads and compiled code stay in the driver for a while. A graph of at
most LOCAL distinct edges, 2 MB, is one task's bounded work instead; any larger one takes the steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import materialise, release

HUBS = 1000
LOCAL = 1 << 17


def least_of_component(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node of each one's component): roots hook onto lesser ones, then paths are halved until flat."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    up, (x, y) = np.arange(len(nodes)), place.reshape(2, -1)
    while len(x):
        x, y = up[x], up[y]
        apart = x != y
        x, y = np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart])
        np.minimum.at(up, x, y)
        while (further := up[up]).tobytes() != up.tobytes():
            up = further
    return nodes, nodes[up]


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        nodes, least = least_of_component(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], names=["node", "label"])


def _with_least(edges: DataFrame, key: str, least: DataFrame, total: int) -> DataFrame:
    """edges joined to (node, m, n) of their `key` end.

    Nodes with over 1 / HUBS of all `total` edge ends are joined by broadcast: there are fewer than HUBS of them, whatever
    the graph. All others hold at most that share of a shuffle.
    """
    limit = total // HUBS
    hubs = F.broadcast(least.where(F.col("n") > limit).select(F.col("node").alias("hub"), F.col("m").alias("hub_m")))
    marked = edges.join(hubs, F.col(key) == F.col("hub"), "left")
    hot = marked.where("hub IS NOT NULL").select("hi", "lo", F.col("hub_m").alias("m"))
    cold = marked.where("hub IS NULL").select("hi", "lo").join(least.where(F.col("n") <= limit), F.col(key) == F.col("node")).select("hi", "lo", "m")
    return hot.unionByName(cold)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node of its component. Nodes without edges do not appear.

    The step count is logarithmic. A node with many neighbours is combined before each shuffle, and its edges are joined
    where they lie. An edge needs the least neighbour of its lower end only: towards the lower end it has nothing to give.
    """
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    before = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
    if before.n <= LOCAL:
        united = materialise(edges.coalesce(1).mapInArrow(_united, "node long, label long"), "united")
        release(edges)
        return united
    while before.n:
        ends = edges.select(F.col("hi").alias("node"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("node"), F.col("hi").alias("v")))
        least = ends.groupBy("node").agg(F.least(F.min("v"), F.col("node")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = materialise(_with_least(edges, "lo", least, 2 * before.n).select("hi", F.col("m").alias("lo")).distinct(), "large")
        low = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("n")).withColumnRenamed("hi", "node")
        kept = low.select(F.col("node").alias("hi"), F.col("m").alias("lo"))
        small = _with_least(large, "hi", low, before.n).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(kept)
        last, edges = edges, materialise(small.where("hi <> lo").distinct(), "edges")
        release(last, large)
        after = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
        if after == before:
            break
        before = after
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct())
