"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrank.llm import store

#: So many edges at most are joined up by one task, which takes them from the shared folder; more go through rounds of joins.
MOST_LOCAL = 200_000
#: So many edges at most are sent to every executor, which saves their joins a shuffle.
MOST_BROADCAST = 200_000


def _chained(edges: DataFrame, side) -> bool:
    """Whether some node has an edge to a smaller one and from a larger one, or edges to two smaller ones."""
    up, down = edges.groupBy("u").agg(F.count("*").alias("n")), edges.select(F.col("v").alias("u")).distinct()
    return bool(up.where("n > 1").unionByName(up.join(side(down), "u", "left_semi")).limit(1).count())


def least_members(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of nodes 0 to n - 1 and edges between i and j, the smallest member of each one's component."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


def _join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        u, v = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = least_members(len(nodes), at[: len(u)], at[len(u) :])
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node that the edges reach.

    Up to MOST_LOCAL edges are joined up by one task. Of more, large-star and
    small-star steps take turns until all edges lead to a node that leads
    nowhere, in a number of rounds that grows with the logarithm of the input.
    Each step is kept in the shared folder; no edge comes to the driver. Null
    ends and loops are left out.
    """
    now = store.keep(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct(), "edges")
    # Star steps never make more edges than there were.
    many = now.count()
    if many <= MOST_LOCAL:
        return now.select("u", "v").coalesce(1).mapInArrow(_join_up, "node long, root long")
    side = F.broadcast if many <= MOST_BROADCAST else lambda df: df
    while _chained(now, side):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        # Large star: the larger neighbours of each node are tied to the least of node and neighbours.
        large = both.join(side(least), F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        mid = store.keep(large, "edges")
        # Small star: each node and its smaller neighbours are tied to the least of these.
        least = mid.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        joined = mid.join(side(least), F.col("u") == F.col("w"))
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()
        after = store.keep(small, "edges")
        store.remove(now)
        store.remove(mid)
        now = after
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
