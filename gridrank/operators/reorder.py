"""Numbering and permutations."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridrank.operators import stats
from gridrank.session import Kept


def numbered(rows: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """The rows with their place, from 0, in the order of columns that tell all rows apart.

    Rows are ranged over tasks and sorted there; one count for each task tells where it begins.
    """
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    mark = "__place"
    placed = Kept(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(mark, F.monotonically_increasing_id()), "numbered").df
    task, within = F.shiftright(mark, 33), F.col(mark).bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(task.alias("__task")).agg(F.count("*").alias("n"))
    first = counts.select("__task", F.coalesce(F.sum("n").over(Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first"))
    # One row for each task.
    return placed.join(F.broadcast(first), task == F.col("__task")).withColumn(name, F.col("__first") + within).drop(mark, "__task", "__first")


def order_by_sum(matrix: DataFrame, axis: str) -> DataFrame:
    """(old, new) indices of rows ('i') or columns ('j') that have cells, by descending sum, ties by index."""
    sums = (stats.row_sums(matrix) if axis == "i" else stats.col_sums(matrix)).withColumnRenamed(axis, "old")
    return numbered(sums, [F.desc("total"), F.col("old")], "new").select("old", "new")


def permute(matrix: DataFrame, rows: DataFrame | None = None, cols: DataFrame | None = None) -> DataFrame:
    """Cells moved by (old, new) tables; what a table doesn't name goes."""
    out = matrix
    if rows is not None:
        out = out.join(rows.select(F.col("old").alias("i"), F.col("new").alias("to")), "i").select(F.col("to").alias("i"), "j", "v")
    if cols is not None:
        out = out.join(cols.select(F.col("old").alias("j"), F.col("new").alias("to")), "j").select("i", F.col("to").alias("j"), "v")
    return out


def reorder_rows_by_sum(matrix: DataFrame) -> DataFrame:
    return permute(matrix, rows=order_by_sum(matrix, "i"))


def reorder_cols_by_sum(matrix: DataFrame) -> DataFrame:
    return permute(matrix, cols=order_by_sum(matrix, "j"))


def bandwidth(matrix: DataFrame) -> DataFrame:
    return matrix.agg(F.coalesce(F.max(F.abs(F.col("i") - F.col("j"))), F.lit(0)).alias("bandwidth"))


def reverse_cuthill_mckee(matrix: DataFrame, n: int, most_levels: int | None = None) -> DataFrame:
    """(old, new): nodes by descending breadth-first level, each component searched from its node of least degree.

    Levels grow by joins, all components at once, one round for each level; within
    a level nodes stand by the place of the first neighbour before them, then by degree.
    Levels grow until none is left; more than `most_levels` of them, if given, are an error.
    """
    spark = matrix.sparkSession
    both = matrix.select("i", "j").unionByName(matrix.select(F.col("j").alias("i"), F.col("i").alias("j"))).where("i <> j").distinct()
    edges = Kept(both, "rcm_edges")
    degree = edges.df.groupBy("i").agg(F.count("*").alias("degree"))
    nodes = Kept(spark.range(n).select(F.col("id").alias("k")).join(degree.withColumnRenamed("i", "k"), "k", "left").fillna(0, ["degree"]), "rcm_nodes").df
    # Components by the least (degree, node) that reaches each node.
    label = Kept(nodes.select("k", F.struct("degree", "k").alias("root")), "rcm_label")
    while True:
        seen = edges.df.join(label.df.select(F.col("k").alias("j"), "root"), "j").groupBy("i").agg(F.min("root").alias("near"))
        after = Kept(label.df.join(seen.withColumnRenamed("i", "k"), "k", "left").select("k", F.least("root", F.coalesce("near", "root")).alias("root"), (F.col("near") < F.col("root")).alias("changed")), "rcm_label")
        changed = after.df.where("changed").limit(1).count()
        label.drop()
        label = after
        if not changed:
            break
    start = label.df.where(F.col("root.k") == F.col("k")).select("k", F.col("root").alias("root"), F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("parent"))
    done = Kept(numbered(start, ["root"], "place").select("k", "root", "level", "place"), "rcm_done")
    front, base = done.df, done.df.count()
    for level in count(1):
        reached = edges.df.join(front.select(F.col("k").alias("i"), "place", "root"), "i").groupBy("j", "root").agg(F.min("place").alias("parent"))
        new = reached.withColumnRenamed("j", "k").join(done.df.select("k"), "k", "left_anti").join(nodes, "k")
        found = numbered(new.select("k", "root", "parent", "degree"), ["root", "parent", "degree", "k"], "within")
        front = Kept(found.select("k", "root", F.lit(level).alias("level"), (F.col("within") + base).alias("place")), "rcm_front").df
        many = front.count()
        if not many:
            break
        if most_levels is not None and level >= most_levels:
            raise RuntimeError(f"more than {most_levels} breadth-first levels")
        base += many
        after = Kept(done.df.unionByName(front), "rcm_done")
        done.drop()
        done = after
    return numbered(done.df, [F.desc("root"), F.desc("level"), F.desc("place")], "new").select(F.col("k").alias("old"), "new")
