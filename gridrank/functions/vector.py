"""Vectors (i, x): element-wise work, products, norms, slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("i", "x").unionByName(b.select("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))


def scale(a: DataFrame, by: float) -> DataFrame:
    return a.select("i", (F.col("x") * by).alias("x"))


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("i", F.col("x").alias("y")), "i").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0.0)).alias("dot"))


def norms(a: DataFrame) -> DataFrame:
    """One row: norm1, norm2, norm2_robust (scaled, so that squares don't overflow) and norm_inf."""
    size = F.abs("x")
    top = a.agg(F.coalesce(F.max(size), F.lit(0.0)).alias("top"))
    scaled = F.col("x") / F.when(F.lit(True), top.scalar())
    robust = F.when(F.max(size) == 0, 0.0).otherwise(F.max(size) * F.sqrt(F.sum(scaled * scaled)))
    return a.agg(F.sum(size).alias("norm1"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm2"), robust.alias("norm2_robust"), F.max(size).alias("norm_inf"))


def slice_elements(a: DataFrame, start: int, end: int) -> DataFrame:
    """The elements of [start, end), from 0."""
    return a.where(F.col("i").between(start, end - 1)).select((F.col("i") - start).alias("i"), "x")


def upscale(a: DataFrame, start: int, n: int) -> DataFrame:
    """The vector at `start` of n elements, 0 elsewhere."""
    whole = a.sparkSession.range(n).select(F.col("id").alias("i"))
    return whole.join(a.select((F.col("i") + start).alias("i"), "x"), "i", "left").select("i", F.coalesce("x", F.lit(0.0)).alias("x"))


def block_add(a: Column | str, b: Column | str) -> Column:
    """Arrays added element by element."""
    return F.zip_with(a, b, lambda x, y: x + y)


def block_dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
