"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.runtime import discard, materialize


def _mark(edges: DataFrame) -> tuple:
    """Rows and a hash sum: equal before and after a round once it changes nothing."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())


def _large(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least node near it."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of them; here a > b in every edge."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    near = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.union(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b), the component being its smallest id.

    Each round is two aggregates and two joins over the edges, written to the shared folder; the number of rounds grows with the logarithm of the
    longest chain. No neighbourhood is collected anywhere: a node's least neighbour is a partial aggregate, and the join with
    it can be split. The driver reads a count and a hash sum a round. Self-loops, repeated edges and empty tables are fine; edges with a null end are
    ignored. Raises if ``rounds`` do not suffice.
    """
    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    mark = _mark(now)
    if mark[0]:
        for _ in range(rounds):
            mid = materialize(_large(now), "components")
            discard(now)
            now = materialize(_small(mid), "components")
            discard(mid)
            before, mark = mark, _mark(now)
            if mark == before:
                break
        else:
            raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select("b", "b").distinct().toDF("id", "component"))
