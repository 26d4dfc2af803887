"""Edits on stored edges: insert edges, and clear the edges into cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.functions.patterns import backward, gap_step
from cellweft.functions.ranges import rect
from cellweft.model import DEP, FF, FR, NO_COMP, PREC, RF, SHEET
from cellweft.operators.compress import Options, compress, expand, with_offsets
from cellweft.operators.lookup import interval_join
from cellweft.runtime import materialize

def add_edges(stored: DataFrame, edges: DataFrame, options: Options = Options()) -> DataFrame:
    """Stored edges with a batch of raw edges added: the sheets that the batch touches are compressed anew, others are left alone.

    Stored edges do not keep the corners' $, but their patterns say which corners stood still: an old edge gets the flags of its pattern, so that it breaks ties as before.
    """
    touched = edges.select(*SHEET).distinct()
    pattern, down = F.col("pattern"), F.col("d_c1") == F.col("d_c2")
    fixed = {"1": pattern.isin(FR, FF), "2": pattern.isin(RF, FF)}
    flags = {f"abs_{axis}{k}": F.coalesce(fixed[k] & (down if axis == "r" else ~down), F.lit(False)) for axis in "rc" for k in "12"}
    old = expand(stored.join(touched, SHEET, "left_semi").withColumns(flags), list(flags))
    old = old.withColumn("seq", F.lit(0)).select(*edges.columns)
    return stored.join(touched, SHEET, "left_anti").unionByName(compress(old.unionByName(edges), options))


def clear_cells(stored: DataFrame, cells: DataFrame) -> DataFrame:
    """Stored edges without those into the given formula cells (file, sheet, row, col); all cells go in one pass.

    A run is split at its cleared cells. A piece keeps the pattern, with the precedents that the pattern gives its cells; a piece of one cell is NoComp. Pieces of
    gap runs start and end at cells of the run. Cells without edges are ignored. An edge is known by its pattern and boxes, which no two edges share.
    """
    edge = [*SHEET, "pattern", *PREC, *DEP, "so_r", "so_c", "eo_r", "eo_c"]
    down = F.col("d_c1") == F.col("d_c2")
    along = F.when(down, F.col("row")).otherwise(F.col("col"))
    hit = _cells_in_edges(stored, cells.select(*SHEET, "row", "col").distinct())
    cuts = hit.groupBy(*edge).agg(F.array_sort(F.collect_set(along)).alias("cuts"), F.first("edge_type").alias("edge_type"))
    cuts = materialize(cuts, "cuts")
    first, last = F.when(down, F.col("d_r1")).otherwise(F.col("d_c1")), F.when(down, F.col("d_r2")).otherwise(F.col("d_c2"))
    bounds = cuts.withColumn("bounds", F.concat(F.array(first - 1), "cuts", F.array(last + 1)))
    pieces = F.transform(F.sequence(F.lit(0), F.size("bounds") - 2), lambda k: F.struct((F.get("bounds", k) + 1).alias("x"), (F.get("bounds", k + 1) - 1).alias("y")))
    split = bounds.select("*", F.explode(pieces).alias("piece"))
    step = gap_step(F.col("pattern"))
    x = first + F.ceil((F.col("piece.x") - first) / step).cast("int") * step
    y = first + F.floor((F.col("piece.y") - first) / step).cast("int") * step
    split = split.withColumns({"x": x, "y": y}).where("x <= y")
    box = F.when(down, rect(F.col("x"), F.col("d_c1"), F.col("y"), F.col("d_c1"))).otherwise(rect(F.col("d_r1"), F.col("x"), F.col("d_r1"), F.col("y")))
    split = split.withColumn("box", box).withColumn("prec", backward(F.col("box")))
    split = split.select(
        *SHEET, *[F.col(f"prec.{k}").alias(f"p_{k}") for k in ("r1", "c1", "r2", "c2")], *[F.col(f"box.{k}").alias(f"d_{k}") for k in ("r1", "c1", "r2", "c2")],
        F.when(F.col("x") == F.col("y"), NO_COMP).otherwise(F.col("pattern")).alias("pattern"), "edge_type",
    )
    rest = stored.join(cuts.select(*edge), edge, "left_anti").select(*stored.columns)
    return rest.unionByName(with_offsets(split))


def _cells_in_edges(stored: DataFrame, cells: DataFrame) -> DataFrame:
    """Pairs of stored edges and the cells (file, sheet, row, col) in their dependent boxes.

    Most edges stand for one line: those of one cell meet it by equality. Of the others, boxes are bucketed dyadically, and a cell is looked for on the levels that they have.
    """
    one = (F.col("d_r1") == F.col("d_r2")) & (F.col("d_c1") == F.col("d_c2"))
    single = stored.where(one).join(cells.withColumnsRenamed({"row": "d_r1", "col": "d_c1"}), [*SHEET, "d_r1", "d_c1"], "left_semi")
    single = single.withColumns({"row": F.col("d_r1"), "col": F.col("d_c1")})
    runs = stored.where(~one)
    box = cells.withColumns({"row2": F.col("row"), "col2": F.col("col")})
    many = interval_join(box, runs, ("row", "col", "row2", "col2"), ("d_r1", "d_c1", "d_r2", "d_c2")).drop("row2", "col2")
    return single.unionByName(many)


def clear_raw(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """Raw edges without those into the given cells."""
    cells = cells.select(*SHEET, F.col("row").alias("dep_row"), F.col("col").alias("dep_col")).distinct()
    return edges.join(cells, [*SHEET, "dep_row", "dep_col"], "left_anti")
