"""Products of matrices and vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrank.operators import blocks, coo, joins
from gridrank.schema import VECTOR_BLOCK


def spmv(matrix: DataFrame, vector: DataFrame, alpha: float = 1.0) -> DataFrame:
    """alpha A x by key and value: a join on the column, a sum by the row. Rows without cells are absent."""
    scaled = F.sum("product") if alpha == 1.0 else alpha * F.sum("product")
    return joins.matrix_vector(matrix, vector).groupBy("i").agg(scaled.alias("x"))


def spmv_broadcast(matrix: DataFrame, vector: DataFrame, alpha: float = 1.0) -> DataFrame:
    """The same with the vector sent to every executor, if a count shows that it is small; cells don't move before the sum."""
    return spmv(matrix, joins.sized(vector), alpha)


def spmv_cross(matrix: DataFrame, vector: DataFrame, n: int) -> DataFrame:
    """The same with the whole vector as one dense array beside every cell, read by position; beyond a million elements it is joined instead."""
    if n > joins.MOST_BROADCAST:
        return spmv(matrix, vector)
    whole = blocks.vector_blocks(vector, n, n).select(F.col("data").alias("all_x"))
    attached = joins.attach(matrix, whole)
    return attached.select("i", (F.col("v") * F.get("all_x", F.col("j").cast("int"))).alias("product")).groupBy("i").agg(F.sum("product").alias("x"))


def _multiply(batch: pa.RecordBatch):
    """Of each packed block: its first row, its height, the rows that have cells and their sums."""
    column = {name: batch.column(name) for name in ("start_row", "indptr", "indices", "data", "x_data")}
    for k in range(len(batch)):
        pointers, indices, data, x = (column[c][k].values.to_numpy() for c in ("indptr", "indices", "data", "x_data"))
        rows = np.flatnonzero(np.diff(pointers))
        sums = np.add.reduceat(data * x[indices], pointers[rows]) if len(rows) else np.zeros(0)
        yield column["start_row"][k].as_py(), len(pointers) - 1, rows, sums


def _block_parts(batches):
    for batch in batches:
        for start, height, rows, sums in _multiply(batch):
            out = np.zeros(height)
            out[rows] = sums
            yield pa.RecordBatch.from_arrays([pa.array([start], pa.int64()), pa.array([out], pa.list_(pa.float64()))], ["start_row", "data"])


def _element_parts(batches):
    for batch in batches:
        for start, _, rows, sums in _multiply(batch):
            yield pa.RecordBatch.from_arrays([pa.array(rows + start, pa.int64()), pa.array(sums)], ["i", "x"])


def _beside(packed: DataFrame, x_blocks: DataFrame) -> DataFrame:
    """Packed blocks joined with vector blocks on the start column; the vector blocks are as wide as the grid's columns."""
    vector = x_blocks.select(F.col("start_row").alias("at"), F.col("data").alias("x_data"))
    return packed.join(vector, F.col("start_col") == F.col("at")).select("start_row", "indptr", "indices", "data", "x_data")


def spmv_blocks(packed: DataFrame, x_blocks: DataFrame) -> DataFrame:
    """(start_row, data): blocks multiplied where they are, added by start row; the result's blocks are as high as the grid's rows."""
    return add_blocks(_beside(packed, x_blocks).mapInArrow(_block_parts, VECTOR_BLOCK))


def spmv_block_elements(packed: DataFrame, x_blocks: DataFrame) -> DataFrame:
    """(i, x): the same product as elements, of rows that have cells only; a block sends no more than it has of these."""
    return _beside(packed, x_blocks).mapInArrow(_element_parts, "i long, x double").groupBy("i").agg(F.sum("x").alias("x"))


def add_blocks(parts: DataFrame) -> DataFrame:
    """Vector blocks added element by element; sums are combined before the shuffle."""
    cells = parts.select("start_row", F.posexplode("data").alias("p", "x")).groupBy("start_row", "p").agg(F.sum("x").alias("x"))
    return cells.groupBy("start_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda e: e["x"]).alias("data"))


def from_blocks(parts: DataFrame) -> DataFrame:
    """The elements of vector blocks."""
    return parts.select("start_row", F.posexplode("data").alias("p", "x")).select((F.col("start_row") + F.col("p")).alias("i"), "x")


def add_scaled(y: DataFrame, x: DataFrame, alpha: float = 1.0) -> DataFrame:
    """y + alpha x; absent elements are 0."""
    both = y.select("i", "x").unionByName(x.select("i", (alpha * F.col("x")).alias("x")))
    return both.groupBy("i").agg(F.sum("x").alias("x"))


def mult_add(matrix: DataFrame, x: DataFrame, y: DataFrame, alpha: float = 1.0) -> DataFrame:
    return add_scaled(y, spmv(matrix, x), alpha)


def trans_mult(matrix: DataFrame, x: DataFrame) -> DataFrame:
    return spmv(coo.transpose(matrix), x)


def trans_mult_add(matrix: DataFrame, x: DataFrame, y: DataFrame, alpha: float = 1.0) -> DataFrame:
    return add_scaled(y, trans_mult(matrix, x), alpha)


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """C = A B: one join on the inner index, sums combined before the shuffle."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("to"), F.col("v").alias("w"))
    return a.join(right, F.col("j") == F.col("k")).groupBy("i", F.col("to").alias("c")).agg(F.sum(F.col("v") * F.col("w")).alias("v")).select("i", F.col("c").alias("j"), "v")


def bcsr(matrix: DataFrame, height: int = 2, width: int = 2) -> DataFrame:
    """(block_row, block_col, data): non-empty small dense blocks, row by row, filled with 0."""
    place = (F.col("i") % height * width + F.col("j") % width).cast("int")
    sums = [F.coalesce(F.sum(F.when(F.col("p") == k, F.col("v"))), F.lit(0.0)) for k in range(height * width)]
    cells = matrix.select(F.floor(F.col("i") / height).alias("block_row"), F.floor(F.col("j") / width).alias("block_col"), place.alias("p"), "v")
    return cells.groupBy("block_row", "block_col").agg(F.array(*sums).alias("data"))


def bcsr_mult(blocked: DataFrame, vector: DataFrame, height: int = 2, width: int = 2, n: int | None = None) -> DataFrame:
    """A x of such blocks; with n, rows beyond the matrix that the last block pads are left out."""
    size = F.struct((F.col("i") % width).cast("int").alias("p"), "x")
    parts = vector.groupBy(F.floor(F.col("i") / width).alias("at")).agg(F.map_from_entries(F.collect_list(size)).alias("m"))
    x = lambda c: F.coalesce(F.element_at("m", F.lit(c)), F.lit(0.0))
    row = lambda r: F.struct((F.col("block_row") * height + r).alias("i"), sum((F.element_at("data", r * width + c + 1) * x(c) for c in range(width)), F.lit(0.0)).alias("x"))
    both = blocked.join(parts, F.col("block_col") == F.col("at")).select(F.explode(F.array(*[row(r) for r in range(height)])).alias("e"))
    out = both.groupBy(F.col("e.i").alias("i")).agg(F.sum("e.x").alias("x"))
    return out if n is None else out.where(F.col("i") < n)


def block_mult_realigned(packed: DataFrame, vector: DataFrame) -> DataFrame:
    """Packed blocks times a vector of the whole length, at the blocks' offsets."""
    return spmv(blocks.unpack(packed), vector)

