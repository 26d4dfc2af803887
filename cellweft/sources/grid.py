"""In-memory grids, and any table of cell texts, as a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRID = "file string, sheet string, row int, col int, text string"


def grid_cells(spark: SparkSession, sheets: dict[str, list[list[str]]], file: str = "grid") -> DataFrame:
    """Cell texts of a map from sheet names to rows of texts: ``=`` starts a formula, an empty text is a blank cell.

    The first row's width holds for all rows, as in a rectangular grid; what is missing is blank.
    """
    rows = []
    for name, grid in sheets.items():
        width = len(grid[0]) if grid else 0
        rows += [(file, name, r, c, (line[c] if c < len(line) else "") or "") for r, line in enumerate(grid) for c in range(width)]
    return spark.createDataFrame(rows, GRID)


def normalized(cells: DataFrame) -> DataFrame:
    """Cell texts under the engine's sheet keys: a comma in a name becomes a hyphen."""
    return cells.withColumn("sheet", F.regexp_replace("sheet", ",", "-"))
