"""Joins of matrices, vectors and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side is sent to every executor; larger ones are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def sized(side: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """The side, marked for broadcast if a count, which stops at the bound, shows that it is small."""
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side


def tiny_join(left: DataFrame, right: DataFrame, on: Column | list[str], how: str = "inner") -> DataFrame:
    """A join with a side that is expected to be small, and is broadcast if it is."""
    return left.join(sized(right), on, how)


def dangling_join(ranks: DataFrame, dangling: DataFrame) -> DataFrame:
    """The ranks (k, r) of dangling nodes (k)."""
    return ranks.join(dangling.select("k"), "k", "left_semi")


def matrix_vector(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """(i, j, product) of every cell and the vector's element at its column; Spark picks the join."""
    return matrix.join(vector.select(F.col("i").alias("at"), "x"), F.col("j") == F.col("at")).select("i", "j", (F.col("v") * F.col("x")).alias("product"))


def deltas(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, delta): absolute changes of what both have."""
    return old.select(key, F.col(value).alias("was")).join(new.select(key, F.col(value).alias("now")), key).select(key, F.abs(F.col("now") - F.col("was")).alias("delta"))


def attach(rows: DataFrame, scalar: DataFrame) -> DataFrame:
    """Every row with the columns of a table of one row, as scalar subqueries give them: a second row is an error."""
    out = rows
    for c in scalar.columns:
        out = out.withColumn(c, scalar.select(c).scalar())
    return out


def fill_missing_columns(matrix: DataFrame, n: int) -> DataFrame:
    """The cells, and for each index in 0..n-1 that no cell has as column a full column of 1 / n.

    Its size is that of the result it stands for, missing times n; ranking uses a scalar instead.
    """
    spark = matrix.sparkSession
    missing = spark.range(n).select(F.col("id").alias("j")).join(matrix.select("j").distinct(), "j", "left_anti")
    dense = missing.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("i"), "j", F.lit(1.0 / n).alias("v"))
    return matrix.select("i", "j", "v").unionByName(dense)


def rank_products(ranks: DataFrame, matrix: DataFrame) -> DataFrame:
    """(i, product) of ranks (k, r) and the cells of their columns; ranks without cells give nothing."""
    return matrix.join(ranks, F.col("j") == F.col("k")).select("i", (F.col("v") * F.col("r")).alias("product"))


def with_value(rows: DataFrame, values: DataFrame, on: str) -> DataFrame:
    """Every row with the values of its key (null where there is none), which go to every executor if a count shows that they are few."""
    key, *_ = values.columns
    keyed = values.withColumnRenamed(key, "value_key")
    return rows.join(sized(keyed), F.col(on) == F.col("value_key"), "left").drop("value_key")
