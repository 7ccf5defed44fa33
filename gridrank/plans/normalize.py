"""The normalised, transposed matrix as text, with full columns for dangling nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gridrank.operators import coo, joins, stats
from gridrank.sources import vectors


def export(matrix: DataFrame, n: int, path: str) -> None:
    """Lines `row column value`; values are divided by the number of cells in their row before the transpose."""
    vectors.write_text(joins.fill_missing_columns(coo.transpose(stats.row_normalize(matrix, "count")), n), path)
