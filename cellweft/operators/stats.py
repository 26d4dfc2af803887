"""Counts and histograms of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.functions.patterns import gap_step
from cellweft.model import DEP, PATTERNS, PREC, RECT, SHEET
from cellweft.operators.extract import distinct_edges


def _boxes(stored: DataFrame) -> DataFrame:
    as_rect = lambda cols: F.struct(*[F.col(c).alias(k) for c, k in zip(cols, RECT)])
    return stored.select(*SHEET, F.explode(F.array(as_rect(PREC), as_rect(DEP))).alias("box"))


def edge_counts(edges: DataFrame, once: bool = False) -> DataFrame:
    """file, sheet, num_edges, num_vertices of raw edges: distinct (range, cell) pairs, and distinct rectangles at either end. ``once`` says that no edge is there twice."""
    e = edges if once else distinct_edges(edges)
    n = e.groupBy(*SHEET).agg(F.count("*").alias("num_edges"))
    as_rect = lambda cols: F.struct(*[F.col(c).alias(k) for c, k in zip(cols, RECT)])
    boxes = e.select(*SHEET, F.explode(F.array(as_rect(RECT), as_rect(["dep_row", "dep_col", "dep_row", "dep_col"]))).alias("box")).distinct()
    return n.join(boxes.groupBy(*SHEET).agg(F.count("*").alias("num_vertices")), SHEET)


def stored_counts(stored: DataFrame) -> DataFrame:
    """file, sheet, num_comp_edges, num_comp_vertices."""
    n = stored.groupBy(*SHEET).agg(F.count("*").alias("num_comp_edges"))
    return n.join(_boxes(stored).distinct().groupBy(*SHEET).agg(F.count("*").alias("num_comp_vertices")), SHEET)


def formula_counts(cells: DataFrame) -> DataFrame:
    """file, sheet, num_formulas: supported formulas, those without references included."""
    return cells.groupBy(*SHEET).agg(F.count_if("is_formula").alias("num_formulas"))


def sheet_extent(cells: DataFrame) -> DataFrame:
    """file, sheet, max_row, max_col, num_rows (rows that have a cell)."""
    return cells.groupBy(*SHEET).agg(F.max("row").alias("max_row"), F.max("col").alias("max_col"), F.count_distinct("row").alias("num_rows"))


def skip_sheets(cells: DataFrame, threshold: int) -> DataFrame:
    """Files whose sheets together have no more than ``threshold`` rows."""
    return cells.select(*SHEET, "row").distinct().groupBy("file").count().where(F.col("count") <= threshold).select("file")


def ref_distribution(cells: DataFrame) -> DataFrame:
    """num_refs, formulas: how many formulas have so many references, repeats included."""
    return cells.where("is_formula").groupBy("num_refs").agg(F.count("*").alias("formulas"))


def pattern_counts(stored: DataFrame) -> DataFrame:
    """file, sheet, pattern, stored, represented: stored edges, and the raw edges (dependent cells) they stand for."""
    long = F.greatest(F.col("d_r2") - F.col("d_r1"), F.col("d_c2") - F.col("d_c1"))
    cells = (F.floor(long / gap_step(F.col("pattern"))) + 1).cast("long")
    return stored.groupBy(*SHEET, "pattern").agg(F.count("*").alias("stored"), F.sum(cells).alias("represented"))


def workbook_statistics(cells: DataFrame, edges: DataFrame, stored: DataFrame, once: bool = False) -> DataFrame:
    """A row per file, as the statistics CSV has it: counts, and for each pattern stored (``_Comp``) and represented (``_NoComp``) edges."""
    per_file = lambda df, *names: df.groupBy("file").agg(*[F.sum(n).alias(n) for n in names])
    long = pattern_counts(stored)
    wide = long.groupBy("file").agg(*[F.sum(F.when(F.col("pattern") == p, F.col(c)).otherwise(0)).alias(f"{p}_{s}") for p in PATTERNS for c, s in (("stored", "Comp"), ("represented", "NoComp"))])
    out = per_file(formula_counts(cells), "num_formulas").join(per_file(edge_counts(edges, once), "num_vertices", "num_edges"), "file", "left")
    out = out.join(per_file(stored_counts(stored), "num_comp_vertices", "num_comp_edges"), "file", "left").join(wide, "file", "left")
    return out.withColumnsRenamed({"file": "fileName", "num_formulas": "numFormulae", "num_vertices": "numVertices", "num_edges": "numEdges", "num_comp_vertices": "numCompVertices", "num_comp_edges": "numCompEdges"})
