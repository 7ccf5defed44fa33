"""Coordinate matrices: projections, mirrors, offsets, filters. All are narrow but canonical()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(matrix: DataFrame) -> DataFrame:
    """Repeated cells added up."""
    return matrix.groupBy("i", "j").agg(F.sum("v").alias("v"))


def column_values(matrix: DataFrame) -> DataFrame:
    return matrix.select("j", "v")


def row_values(matrix: DataFrame) -> DataFrame:
    return matrix.select("i", "v")


def transpose(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def offset(matrix: DataFrame, by: int) -> DataFrame:
    return matrix.select((F.col("i") + by).alias("i"), (F.col("j") + by).alias("j"), "v")


def symmetrize(matrix: DataFrame, kind: str = "symmetric") -> DataFrame:
    """Each cell off the diagonal and its mirror, negated if skew-symmetric; one pass, no shuffle."""
    if kind == "general":
        return matrix
    if kind not in ("symmetric", "skew-symmetric"):
        raise ValueError(f"can't expand {kind}")
    mirror = -F.col("v") if kind == "skew-symmetric" else F.col("v")
    own = F.struct("i", "j", "v")
    both = F.array(own, F.struct(F.col("j").alias("i"), F.col("i").alias("j"), mirror.alias("v")))
    return matrix.select(F.explode(F.when(F.col("i") == F.col("j"), F.array(own)).otherwise(both)).alias("e")).select("e.i", "e.j", "e.v")


def drop_size_line(entries: DataFrame, n: int, m: int, nnz: float) -> DataFrame:
    """Without the rows equal to the size line; a reader that knows its place is safer."""
    return entries.where(~((F.col("i") == n) & (F.col("j") == m) & (F.col("v") == float(nnz))))


def present(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose column is neither null nor false."""
    return rows.where(F.col(column))


def moved(delta: Column | str, tolerance: float = 1e-5) -> Column:
    """Whether a change is beyond the tolerance."""
    return F.abs(delta) > tolerance


def sort_key(i: Column | str = "i", j: Column | str = "j") -> Column:
    """Row in the upper, column in the lower 32 bits."""
    i, j = (F.col(c) if isinstance(c, str) else c for c in (i, j))
    return F.shiftleft(i, 32).bitwiseOR(j)


def slice_cells(matrix: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """The submatrix of [start, end) rows and columns, from 0."""
    inside = matrix.where(F.col("i").between(rows[0], rows[1] - 1) & F.col("j").between(cols[0], cols[1] - 1))
    return inside.select((F.col("i") - rows[0]).alias("i"), (F.col("j") - cols[0]).alias("j"), "v")


def cell(matrix: DataFrame, i: int, j: int, n: int, m: int) -> DataFrame:
    """One row with the value at a place, 0 where nothing is stored; places beyond the matrix are an error."""
    if not (0 <= i < n and 0 <= j < m):
        raise IndexError(f"({i}, {j}) is beyond {n} x {m}")
    return matrix.where((F.col("i") == i) & (F.col("j") == j)).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"))
