"""Scalar functions: range algebra as Columns, and formula parsing."""
