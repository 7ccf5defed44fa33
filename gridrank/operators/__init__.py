"""Operators on coordinate matrices (i, j, v) and vectors (i, x)."""
