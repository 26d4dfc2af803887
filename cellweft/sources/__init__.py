"""Readers and writers: workbooks, grids, manifests, statistics and edge lists."""
