"""Dependency operators over DataFrames: extract, compress, look up, edit, chains, statistics."""
