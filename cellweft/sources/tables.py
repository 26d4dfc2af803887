"""Manifests, reference distributions, statistics and edge lists as text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweft.functions.ranges import cell_of, rect, to_text
from cellweft.model import SHEET


def read_manifest(cells: DataFrame, headers: list[str]) -> DataFrame:
    """Rows of a manifest sheet: file, sheet, row, and a column for each of ``headers``.

    ``cells`` has the sheet's cell texts. Headers stand in row 0 and are matched without regard to case and outer blanks, in any column, the last one included. Of
    a header that occurs twice the leftmost counts. Rows without any of the values are left out; formulas are not values.
    """
    top = cells.where("row = 0").select(*SHEET, "col", F.lower(F.trim("text")).alias("header"))
    top = top.withColumn("nth", F.row_number().over(Window.partitionBy(*SHEET, "header").orderBy("col"))).where("nth = 1").drop("nth")
    body = cells.where("row > 0 and text is not null and text != '' and not startswith(text, '=')").join(top, [*SHEET, "col"])
    wanted = {h: h.strip().lower() for h in headers}
    picked = [F.max(F.when(F.col("header") == low, F.col("text"))).alias(h) for h, low in wanted.items()]
    return body.where(F.col("header").isin(list(wanted.values()))).groupBy(*SHEET, "row").agg(*picked)


def manifest_queries(manifest: DataFrame, name_col: str, ref_col: str) -> DataFrame:
    """Lookup queries of a manifest: qid (the row), target (the named file), sheet and the cell that a text like ``Sheet:N2`` names."""
    cell = cell_of(F.col(ref_col))
    named = manifest.withColumns({"cell": cell, "of": F.element_at(F.split(F.col(ref_col), ":"), 1)})
    return named.where("cell is not null").select(F.col("row").cast("long").alias("qid"), F.col(name_col).alias("target"), F.col("of").alias("sheet"), "cell.r1", "cell.c1", "cell.r2", "cell.c2")


def read_ref_distribution(spark: SparkSession, path: str) -> DataFrame:
    """num_ref, count of files with lines ``num_ref,count``; lines without exactly two whole numbers are left out."""
    parts = F.split(F.trim("value"), ",")
    lines = spark.read.text(path).select(parts.alias("p")).where(F.size("p") == 2)
    return lines.select(F.expr("try_cast(trim(p[0]) as int)").alias("num_ref"), F.expr("try_cast(trim(p[1]) as bigint)").alias("count")).dropna()


def merged_ref_distribution(parts: DataFrame) -> DataFrame:
    """num_ref, count: distributions of several files added up."""
    return parts.groupBy("num_ref").agg(F.sum("count").alias("count"))


def write_ref_distribution(distribution: DataFrame, path: str) -> None:
    distribution.orderBy(distribution.columns[0]).coalesce(1).write.csv(path)


def write_statistics(statistics: DataFrame, path: str) -> None:
    """A statistics table as CSV with a header."""
    statistics.write.option("header", True).csv(path)


def edge_list(stored: DataFrame) -> DataFrame:
    """file, sheet and a line ``precedents - dependents`` for each stored edge, in A1 names."""
    prec, dep = rect("p_r1", "p_c1", "p_r2", "p_c2"), rect("d_r1", "d_c1", "d_r2", "d_c2")
    return stored.select(*SHEET, F.concat_ws(" - ", to_text(prec), to_text(dep)).alias("line"))


def write_edge_list(stored: DataFrame, path: str) -> None:
    """Edge lines as text, a folder for each sheet, in which a blank line ends the sheet."""
    lines = edge_list(stored)
    ends = lines.select(*SHEET).distinct().withColumn("line", F.lit(""))
    ordered = lines.withColumn("last", F.lit(0)).unionByName(ends.withColumn("last", F.lit(1))).repartition(*SHEET).sortWithinPartitions(*SHEET, "last", "line")
    ordered.select(*SHEET, F.col("line").alias("value")).write.partitionBy(*SHEET).text(path)
