"""Block geometry and packed blocks.

Two conventions: 'ceil', blocks of ceil(n / b) with a shorter last one, and
'floor_last', blocks of floor(n / b) of which the last takes the remainder.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridrank.schema import BLOCK

PLACE = ("block_row", "block_col", "start_row", "start_col", "n_rows", "n_cols")


@dataclass(frozen=True)
class Grid:
    """A rows x cols matrix in b x b blocks of the ceil convention."""

    rows: int
    cols: int
    b: int

    def __post_init__(self):
        if self.b < 1 or self.rows < self.b or self.cols < self.b:
            raise ValueError(f"{self.rows} x {self.cols} can't be cut into {self.b} x {self.b} blocks")

    @property
    def height(self) -> int:
        return -(-self.rows // self.b)

    @property
    def width(self) -> int:
        return -(-self.cols // self.b)

    def key(self, i: Column | str = "i", j: Column | str = "j") -> Column:
        i, j = (F.col(c) if isinstance(c, str) else c for c in (i, j))
        return (F.floor(i / self.height) * self.b + F.floor(j / self.width)).cast("bigint")

    def dims(self, i: int, j: int) -> tuple[int, int, int, int]:
        """First row and column, rows and columns of the block of a cell."""
        if not (0 <= i < self.rows and 0 <= j < self.cols):
            raise IndexError(f"({i}, {j}) is beyond {self.rows} x {self.cols}")
        r, c = i // self.height, j // self.width
        size = lambda k, step, n: n - step * (self.b - 1) if k == self.b - 1 else step
        return r * self.height, c * self.width, size(r, self.height, self.rows), size(c, self.width, self.cols)

    def with_dims(self, cells: DataFrame) -> DataFrame:
        """Cells with block_row, block_col and their block's start_row, start_col, n_rows, n_cols."""
        r, c = F.floor(F.col("i") / self.height), F.floor(F.col("j") / self.width)
        size = lambda k, step, n: F.least(F.lit(step), F.lit(n) - k * step)
        return cells.withColumns({"block_row": r, "block_col": c, "start_row": r * self.height, "start_col": c * self.width, "n_rows": size(r, self.height, self.rows).cast("bigint"), "n_cols": size(c, self.width, self.cols).cast("bigint")})


def vector_block_sizes(spark: SparkSession, cols: int, b: int) -> DataFrame:
    """(start, size) of the blocks of a vector: full ones while another element follows, then the rest; may be fewer than b."""
    step = -(-cols // b)
    many = -(-cols // step)
    return spark.range(many).select((F.col("id") * step).alias("start"), F.least(F.lit(step), cols - F.col("id") * step).cast("bigint").alias("size"))


def adjusted_n(n: int, b: int) -> int:
    """n, padded to a multiple of b."""
    return -(-n // b) * b


def floor_last_key(i: Column, j: Column, n: int, b: int) -> Column:
    size = n // b
    at = lambda k: F.least(F.floor(k / size), F.lit(b - 1))
    return (at(i) * b + at(j)).cast("bigint")


def bit_window(spark: SparkSession, start: int, length: int, size: int) -> DataFrame:
    """The set positions of a bitmap of `size` bits with [start, start + length) set."""
    if start < 0 or start + length > size:
        raise ValueError("the window is beyond the bitmap")
    return spark.range(start, start + length).select(F.col("id").alias("bit"))


def dangling_blocks(nodes: DataFrame, width: int) -> DataFrame:
    """(start_row, positions) of the blocks of a vector that hold dangling nodes; positions within the block, sorted."""
    found = nodes.where("dangling").select((F.floor(F.col("k") / width) * width).alias("start_row"), F.col("k"))
    return found.groupBy("start_row").agg(F.sort_array(F.collect_list((F.col("k") - F.col("start_row")).cast("int"))).alias("positions"))


def _pack(orientation: str):
    def run(table: pa.Table) -> pa.Table:
        c = {name: table[name].to_numpy() for name in table.schema.names}
        i, j = c["i"] - c["start_row"][0], c["j"] - c["start_col"][0]
        outer, inner, n = (i, j, c["n_rows"][0]) if orientation == "csr" else (j, i, c["n_cols"][0])
        order = np.lexsort((c["v"], inner, outer))
        pointers = np.searchsorted(outer[order], np.arange(n + 1))
        row = {k: [int(c[k][0])] for k in PLACE} | {"indptr": [pointers.astype(np.int32)], "indices": [inner[order].astype(np.int32)], "data": [c["v"][order]]}
        return pa.table(row)

    return run


def build(cells: DataFrame, grid: Grid, *, orientation: str = "csr") -> DataFrame:
    """Packed blocks of the non-empty part of the grid: block-local, compressed by row or, as 'csc', by column.

    Cells are sorted within their block; repeated ones are kept and add up in
    products. A block is a task's unit: the grid must be fine enough for one to
    fit in memory, which block_nnz tells beforehand.
    """
    return grid.with_dims(cells.select("i", "j", "v")).groupBy("block_row", "block_col").applyInArrow(_pack(orientation), BLOCK)


def unpack(blocks: DataFrame, orientation: str = "csr") -> DataFrame:
    """The cells of packed blocks."""
    rows = blocks.withColumn("outer", F.flatten(F.transform(F.sequence(F.lit(1), F.size("indptr") - 1), lambda r: F.array_repeat(r - 1, F.element_at("indptr", r + 1) - F.element_at("indptr", r)))))
    cells = rows.select("start_row", "start_col", F.explode(F.arrays_zip("outer", "indices", "data")).alias("c"))
    li, lj = ("c.outer", "c.indices") if orientation == "csr" else ("c.indices", "c.outer")
    return cells.select((F.col("start_row") + F.col(li)).alias("i"), (F.col("start_col") + F.col(lj)).alias("j"), F.col("c.data").alias("v"))


def vector_blocks(vector: DataFrame, width: int, n: int) -> DataFrame:
    """(start_row, data): dense blocks of `width` elements, absent ones 0, as many as hold 0..n-1."""
    spark = vector.sparkSession
    # Absent elements of a block are 0, in time proportional to its width: every place gets one, and sums meet those that are there.
    every = spark.range(n).select(start_of("id", width), (F.col("id") % width).cast("int").alias("p"), F.lit(0.0).alias("x"))
    own = vector.select(start_of("i", width), (F.col("i") % width).cast("int").alias("p"), "x")
    cells = every.unionByName(own).groupBy("start_row", "p").agg(F.sum("x").alias("x"))
    return cells.groupBy("start_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda e: e["x"]).alias("data"))


def start_of(column: str, width: int) -> Column:
    return (F.floor(F.col(column) / width) * width).alias("start_row")
