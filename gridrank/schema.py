"""Schemas and metadata of matrices, vectors and graphs. Indices are 0-based."""

from __future__ import annotations

from dataclasses import dataclass

COO = "i bigint, j bigint, v double"
VECTOR = "i bigint, x double"
BLOCK = "block_row bigint, block_col bigint, start_row bigint, start_col bigint, n_rows bigint, n_cols bigint, indptr array<int>, indices array<int>, data array<double>"
VECTOR_BLOCK = "start_row bigint, data array<double>"

# Fixed values of the Matrix Market format.
LAYOUTS = ("coordinate", "array")
FIELDS = ("real", "integer", "complex", "pattern")
SYMMETRIES = ("general", "symmetric", "skew-symmetric", "hermitian")


@dataclass(frozen=True)
class MatrixInfo:
    layout: str
    field: str
    symmetry: str
    n: int
    m: int
    nnz: int


@dataclass(frozen=True)
class GraphInfo:
    n: int
    edges: int | None
    directed: bool
