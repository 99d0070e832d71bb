"""Connected components over an edge table, by alternating large and small stars.

Every round is two aggregations and two joins on node ids; minima are taken
before the shuffle, so a hub costs one row per task.  They are written before
they are joined: both sides of a join then are plain shuffles, and AQE can split
the one on which a hub's edges meet.  Each round is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.shared import discard, saved


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) with the smallest node of each component; nodes without edges to others are absent.

    ``edges`` has long columns a and b.  Self-loops and repeats are allowed.
    """
    e = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    before = None
    for _ in range(rounds):
        both = e.union(e.select("b", "a")).toDF("u", "v")
        lowest = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "components-low")
        large = saved(both.join(lowest, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "components-large")
        low = saved(large.groupBy("a").agg(F.min("b").alias("m")), "components-low")
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, e = e, saved(low.withColumnRenamed("m", "b").union(small).distinct(), "components")
        discard(last, lowest, large, low)
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30)))).first())
        if now == before:
            return e.toDF("node", "root")
        before = now
    raise RuntimeError(f"no fixed point after {rounds} rounds")


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as edges a-b, as one edge from each node to its smallest relative."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: a.size], at[a.size :]
    root = np.arange(nodes.size)
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    keep = root != np.arange(nodes.size)
    return nodes[keep], nodes[root[keep]]
