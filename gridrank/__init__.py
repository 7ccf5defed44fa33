"""Sparse matrices and graph ranking on Spark DataFrames."""
