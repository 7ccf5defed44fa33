"""Readers, generators and writers of matrices, vectors and graphs."""
