"""Sums, counts, histograms and norms. Every grouping is combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col_sums(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("j").agg(F.sum("v").alias("total"))


def row_sums(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("i").agg(F.sum("v").alias("total"))


def row_normalize(matrix: DataFrame, by: str = "sum") -> DataFrame:
    """Values divided by their row's sum, or by its number of cells. A join with the sums: hot rows are combined before the shuffle and split after it."""
    whole = F.sum("v") if by == "sum" else F.count("*").cast("double")
    totals = matrix.groupBy("i").agg(whole.alias("total"))
    return matrix.join(totals, "i").select("i", "j", (F.col("v") / F.col("total")).alias("v"))


def dangling_nodes(matrix: DataFrame, n: int) -> DataFrame:
    """Nodes 0..n-1 without an entry in their row, or whose entries add up to 0."""
    out = row_sums(matrix).where("total <> 0").select(F.col("i").alias("k"))
    return matrix.sparkSession.range(n).select(F.col("id").alias("k")).join(out, "k", "left_anti")


def dangling_mass(ranks: DataFrame, dangling: DataFrame, alpha: float, n: int) -> DataFrame:
    """mass, the dangling nodes' rank, and share, what each node gets of it and of the teleport."""
    mass = ranks.join(dangling.select("k"), "k", "left_semi").agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("mass"))
    return mass.select("mass", (alpha * F.col("mass") / n + (1 - alpha) / n).alias("share"))


def block_nnz(matrix: DataFrame, key: Column) -> DataFrame:
    return matrix.groupBy(key.alias("block_key")).agg(F.count("*").alias("nnz"))


def block_occupancy(counts: DataFrame, b: int) -> DataFrame:
    """Of the counts of non-empty blocks: how many, their share of b * b, and statistics."""
    return counts.agg(
        F.count("*").alias("blocks"),
        (F.count("*") / float(b * b)).alias("share"),
        F.min("nnz").alias("least"),
        F.max("nnz").alias("most"),
        F.avg("nnz").alias("mean"),
        F.stddev_samp("nnz").alias("deviation"),
    )


def heat_map(counts: DataFrame, b: int) -> DataFrame:
    """(line, block_col, nnz) for all b * b blocks, the last line being block row 0."""
    grid = counts.sparkSession.range(b * b).select(F.col("id").alias("block_key"))
    full = grid.join(counts, "block_key", "left")
    return full.select((b - 1 - F.floor(F.col("block_key") / b)).alias("line"), (F.col("block_key") % b).alias("block_col"), F.coalesce("nnz", F.lit(0)).alias("nnz"))


def downsample(matrix: DataFrame, n_cols: int, bins: int = 1000) -> DataFrame:
    """Cells counted in bins of a square picture; scaled by the number of columns."""
    scale = bins / n_cols
    return matrix.groupBy(F.floor(F.col("j") * scale).alias("x"), F.floor(F.col("i") * scale).alias("y")).agg(F.count("*").alias("cells"))


def empirical_bins(values: DataFrame, column: str, bins: int) -> DataFrame:
    """Bins of equal width from the least to the greatest value, each closed above but the first, which is closed on both sides; with counts and statistics."""
    edges = values.agg(F.min(column).alias("low"), F.max(column).alias("high")).first()
    if edges["low"] is None:
        return values.sparkSession.createDataFrame([], "bin bigint, members bigint, least double, most double, mean double")
    width = (edges["high"] - edges["low"]) / bins
    at = F.greatest(F.lit(0), F.ceil((F.col(column) - edges["low"]) / width) - 1) if width else F.lit(0)
    return values.groupBy(F.least(F.lit(bins - 1), at).cast("bigint").alias("bin")).agg(F.count("*").alias("members"), F.min(column).alias("least"), F.max(column).alias("most"), F.avg(column).alias("mean"))


def row_nnz_stats(matrix: DataFrame) -> DataFrame:
    """Of the rows that have cells: greatest, least and mean number, variance and deviation of the population."""
    rows = matrix.groupBy("i").agg(F.count("*").alias("nnz"))
    return rows.agg(F.max("nnz").alias("most"), F.min("nnz").alias("least"), F.avg("nnz").alias("mean"), F.var_pop("nnz").alias("variance"), F.stddev_pop("nnz").alias("deviation"))


def log_rank_hist(ranks: DataFrame) -> DataFrame:
    """How many ranks have each rounded logarithm, ranks scaled to add up to their number."""
    whole = ranks.agg((F.count("*") / F.sum("r")).alias("scale"))
    return ranks.select(F.floor(F.log(F.col("r") * whole.scalar()) + 0.5).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("members"))


def degree_hist(matrix: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells of each row, and of each column."""
    return matrix.groupBy("i").agg(F.count("*").alias("cells")), matrix.groupBy("j").agg(F.count("*").alias("cells"))


def width_hist(values: DataFrame, column: str, width: float) -> DataFrame:
    return values.groupBy((F.lit(float(width)) * F.floor(F.col(column) / width)).alias("low")).agg(F.count("*").alias("members"))


def nnz(matrix: DataFrame) -> DataFrame:
    return matrix.where("v <> 0").agg(F.count("*").alias("nnz"))


def sparsity(matrix: DataFrame, n: int, directed: bool = True) -> DataFrame:
    return matrix.agg((F.count("*") * (1.0 if directed else 2.0) / float(n) / float(n)).alias("sparsity"))


def frobenius(matrix: DataFrame) -> DataFrame:
    return matrix.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))


def total(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(F.sum(column).alias("total"))

