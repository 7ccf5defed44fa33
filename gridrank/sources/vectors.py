"""Vectors: files and generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    return spark.read.csv(path, sep=sep, schema="i bigint, x double")


def write_csv(vector: DataFrame, path: str, sep: str = " ") -> None:
    vector.select("i", "x").write.csv(path, sep=sep)


def write_text(matrix: DataFrame, path: str) -> None:
    """Lines of row, column and value."""
    matrix.select(F.concat_ws(" ", F.col("i").cast("string"), F.col("j").cast("string"), F.col("v").cast("string")).alias("line")).write.text(path)


def numbers(spark: SparkSession, n: int, partitions: int | None = None) -> DataFrame:
    return spark.range(0, n, 1, partitions).select(F.col("id").alias("i"))


def constant(spark: SparkSession, n: int, value: float = 1.0, first: int = 0) -> DataFrame:
    return spark.range(n).select((F.col("id") + first).alias("i"), F.lit(float(value)).alias("x"))


def constant_blocks(spark: SparkSession, n: int, blocks: int, value: float, partitions: int | None = None) -> DataFrame:
    """(start_row, data) of `blocks` blocks of n // blocks equal values."""
    size = n // blocks
    return spark.range(0, blocks, 1, partitions).select((F.col("id") * size).alias("start_row"), F.array_repeat(F.lit(float(value)), size).alias("data"))


def from_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def random_matrix(spark: SparkSession, n: int, fill: float, seed: int = 1000) -> DataFrame:
    """A square matrix of which each cell is filled with that probability, by a uniform value in single precision. Rows are made where they are, without a product of ranges."""
    cells = spark.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("j"))
    return cells.where(F.rand(seed) < fill).select("i", "j", F.rand(seed + 1).cast("float").cast("double").alias("v"))
