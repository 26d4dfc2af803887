"""Whole runs over folders of workbooks that end in a CSV: statistics, lookups that a manifest lists, and deletions down a column."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweft.model import PATTERNS, SHEET
from cellweft.operators import lookup
from cellweft.operators.compress import Options
from cellweft.plans.analyzer import WorkbookAnalyzer
from cellweft.runtime import materialize
from cellweft.sources.tables import manifest_queries, read_manifest, write_statistics
from cellweft.sources.workbook import read_workbooks


def _base(path: str):
    """The last part of a path."""
    return F.element_at(F.split(path, "/"), -1)


def statistics_run(spark: SparkSession, folder: str, out: str, options: Options = Options()) -> DataFrame:
    """Statistics of every workbook of a folder, written to ``out`` as CSV with a header: one row per file, graphBuildTime being that of the whole folder in milliseconds.

    Files that cannot be read have no row.
    """
    analyzer = WorkbookAnalyzer.from_files(spark, folder, options=options)
    counts = ["numFormulae", "numVertices", "numEdges", "numCompVertices", "numCompEdges"]
    found = analyzer.statistics().fillna(0)
    found = found.select(_base("fileName").alias("fileName"), *counts, F.lit(round(analyzer.build_seconds * 1000)).alias("graphBuildTime"), *[f"{p}_{s}" for p in PATTERNS for s in ("Comp", "NoComp")])
    found = materialize(found, "statistics")
    write_statistics(found, out)
    return found


def lookup_run(spark: SparkSession, folder: str, manifest: str, out: str, name_header: str = "File name", ref_header: str = "Max Dep Ref", options: Options = Options()) -> DataFrame:
    """All dependents of the cell that each row of a manifest workbook names, looked up in one pass and written to ``out`` as CSV: fileName, ref, GraphBuildTime, LookupSize, LookupTime.

    LookupSize counts the rectangles of a result, and LookupTime is that of the pass in milliseconds. Rows that name no file of the folder, or no cell, are left out.
    """
    rows = read_workbooks(spark, manifest).where("error is null").drop("error")
    asked = manifest_queries(read_manifest(rows, [name_header, ref_header]), name_header, ref_header).withColumnRenamed("sheet", "of")
    analyzer = WorkbookAnalyzer.from_files(spark, folder, options=options)
    sheets = analyzer.sheets().withColumn("base", _base("file"))
    asked = asked.join(sheets, (asked["target"] == sheets["base"]) & (F.regexp_replace(asked["of"], ",", "-") == sheets["sheet"]))
    asked = materialize(asked.select("qid", *SHEET, "r1", "c1", "r2", "c2", "target", F.concat("of", F.lit(":"), F.lit("r"), F.col("r1") + 1, F.lit("c"), F.col("c1") + 1).alias("ref")), "lookups")
    started = time.monotonic()
    sizes = materialize(lookup.dependents(asked.drop("target", "ref"), analyzer.graph).groupBy("qid").agg(F.count("*").alias("n")), "sizes")
    took = round((time.monotonic() - started) * 1000)
    found = asked.join(sizes, "qid", "left").select(F.col("target").alias("fileName"), "ref", F.lit(round(analyzer.build_seconds * 1000)).alias("GraphBuildTime"), F.coalesce("n", F.lit(0)).alias("LookupSize"), F.lit(took).alias("LookupTime"))
    found = materialize(found, "lookup-run")
    write_statistics(found, out)
    return found


def deletion_run(analyzer: WorkbookAnalyzer, sheet: str, row: int, col: int, count: int = 1000, file: str | None = None) -> float:
    """Seconds to clear ``count`` formula cells down a column, from (row, col) on, in one batch; the analyzer's graph has them no more."""
    where = analyzer.sheets().where(F.col("sheet") == sheet.replace(",", "-"))
    where = where if file is None else where.where(F.col("file") == file)
    cells = where.select(*SHEET, F.explode(F.sequence(F.lit(row), F.lit(row + count - 1))).alias("row"), F.lit(col).alias("col"))
    started = time.monotonic()
    analyzer.clear_cells(cells)
    return time.monotonic() - started
