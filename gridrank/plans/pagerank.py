"""PageRank as a driver loop over one plan for each round."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrank.operators import blocks, joins, linalg, stats
from gridrank.session import Kept, buckets

#: A node with more than this part of the links is a hub; so many at most can be.
HUBS = 1000


@dataclass
class Ranking:
    ranks: DataFrame  # k, r
    rounds: int
    delta: float | None
    seconds: float
    history: list[tuple[int, float | None, float, float]] = field(default_factory=list)  # round, delta, mass, seconds

    def report(self) -> DataFrame:
        """One row for each round."""
        return self.ranks.sparkSession.createDataFrame(self.history, "round int, delta double, dangling_mass double, seconds double")


def pagerank(matrix: DataFrame, n: int, *, alpha: float = 0.85, tolerance: float | None = 1e-11, most_rounds: int = 1000, normalize: str = "sum", b: int | None = None, most_broadcast: int = joins.MOST_BROADCAST) -> Ranking:
    """Ranks of the nodes 0..n-1 of a weighted graph, r' = alpha W' r + (1 - alpha) / n + alpha (rank of dangling nodes) / n.

    Stops when the ranks change by at most `tolerance` in sum, or after `most_rounds`.
    The transition matrix is written once; a round joins it with the ranks, adds up
    by target before and after the shuffle, and writes the ranks to the shared
    folder, so that lineage ends and lost executors cost one round at most. Links
    don't move: up to `most_broadcast` nodes, the ranks go to every executor;
    beyond, both are kept in buckets of the source, and only the ranks of hubs,
    fewer than HUBS, go to the links of these, which lie in no bucket. Only two
    numbers come to the driver. With b, the product uses packed blocks of a b x b
    grid. Every node keeps a rank, linked to or not.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    spark = matrix.sparkSession
    began = time.time()
    if matrix.where("v < 0").limit(1).count():
        raise ValueError("weights must not be negative")
    weights = stats.row_normalize(matrix.where("v <> 0"), normalize)
    grid = blocks.Grid(n, n, b) if b else None
    by, hub_links = None, None
    if grid:
        links = Kept(blocks.build(weights.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), grid), "links")
    elif n <= most_broadcast:
        links = Kept(weights, "links")
    else:
        by, plain = "k", Kept(weights, "weights")
        out = plain.df.groupBy(F.col("i").alias("k")).agg(F.count("*").alias("many"))
        hubs = Kept(out.where(F.col("many") * HUBS > plain.df.count()).select("k"), "hubs")
        if hubs.df.limit(1).count():
            hub_links = Kept(plain.df.join(F.broadcast(hubs.df), F.col("i") == F.col("k"), "left_semi"), "hub_links")
        rest = plain.df.join(F.broadcast(hubs.df), F.col("i") == F.col("k"), "left_anti")
        links = Kept(rest.repartition(buckets(spark), "i"), "links", "i")
        plain.drop()
    nodes = Kept(spark.range(n).select(F.col("id").alias("k")).join(matrix.where("v <> 0").select(F.col("i").alias("k")).distinct().withColumn("out", F.lit(True)), "k", "left").select("k", F.col("out").isNull().alias("dangling")), "nodes")
    # Each table of ranks holds its change and its dangling mass in columns, so that a round is one job and one small sum.
    first = nodes.df.select("k", F.lit(1.0 / n).alias("r"), "dangling", F.lit(0.0).alias("moved"))
    now = Kept(first.repartition(buckets(spark), "k") if by else first, "ranks", by)
    history, rounds, delta = [], 0, None
    while rounds < most_rounds:
        at = time.time()
        mass = now.df.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("r"))), F.lit(0.0))).first()[0]
        base = (1 - alpha) / n + alpha * mass / n
        if grid:
            x = blocks.vector_blocks(now.df.select(F.col("k").alias("i"), F.col("r").alias("x")), grid.width, n)
            sums = linalg.spmv_block_elements(links.df, x).select(F.col("i").alias("to"), F.col("x").alias("s"))
        else:
            ranks = now.df.select("k", "r")
            products = joins.rank_products(ranks if by else F.broadcast(ranks), links.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
            if hub_links:
                theirs = F.broadcast(ranks.join(F.broadcast(hubs.df), "k", "left_semi"))
                products = products.unionByName(joins.rank_products(theirs, hub_links.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")))
            sums = products.groupBy(F.col("i").alias("to")).agg(F.sum("product").alias("s"))
        moved = now.df.join(sums, F.col("k") == F.col("to"), "left").select("k", (alpha * F.coalesce("s", F.lit(0.0)) + base).alias("r"), "dangling", F.col("r").alias("was"))
        after = Kept(moved.select("k", "r", "dangling", F.abs(F.col("r") - F.col("was")).alias("moved")), "ranks", by)
        now.drop()
        now, rounds = after, rounds + 1
        if tolerance is not None:
            delta = now.df.agg(F.sum("moved")).first()[0]
        history.append((rounds, delta, float(mass), time.time() - at))
        if tolerance is not None and delta <= tolerance:
            break
    for table in (links, nodes, *([hubs] if by else []), *([hub_links] if hub_links else [])):
        table.drop()
    return Ranking(now.df.select("k", "r"), rounds, delta, time.time() - began, history)


def rank_mass(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.sum(F.abs("r")).alias("mass"))
