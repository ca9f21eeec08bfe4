"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import HEAVY, spread_join
from .staging import Staged


def local_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the same components as the given ones: each node with its component's smallest node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    up = np.arange(len(nodes))
    while True:
        low = np.minimum(up[a], up[b])
        new = up.copy()
        np.minimum.at(new, up[a], low)
        np.minimum.at(new, up[b], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == up).all():
            break
        up = new
    other = np.flatnonzero(up != np.arange(len(nodes)))
    return nodes[other], nodes[up[other]]


def connected_components(edges: DataFrame, staged: Staged) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u, v); root is the component's smallest node.

    Each round joins every node with the smallest neighbour known so far and is
    written to the shared folder; a hub is never gathered into one list.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    now = staged.put(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = state(now)
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = low_kept = staged.put(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select("u", F.least("u", "m").alias("m"), "c"))
        hubs = low.where(F.col("c") * HEAVY > 2 * before[0])
        large = spread_join(both.where("v > u"), low.drop("c"), ["u"], hubs).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged.put(large.union(now.groupBy("u").agg(F.min("v").alias("v"))).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        hubs = low.where(F.col("c") * HEAVY > 2 * before[0])
        small = spread_join(large, low.drop("c"), ["u"], hubs).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v"))).where("u <> v")
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        new = staged.put(small)
        after = state(new)
        staged.drop(now, low_kept, large)
        now = new
        if after == before:
            break
        before = after
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
