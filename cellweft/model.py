"""Table schemas, and the small vocabularies that all operators share."""

from __future__ import annotations

CELLS = "file string, sheet string, row int, col int, value string, formula string, is_formula boolean, num_refs int, error string"
EDGES_RAW = "file string, sheet string, dep_row int, dep_col int, seq int, r1 int, c1 int, r2 int, c2 int, abs_r1 boolean, abs_c1 boolean, abs_r2 boolean, abs_c2 boolean, edge_type string"
EDGES_COMP = "file string, sheet string, p_r1 int, p_c1 int, p_r2 int, p_c2 int, d_r1 int, d_c1 int, d_r2 int, d_c2 int, pattern string, so_r int, so_c int, eo_r int, eo_c int, edge_type string"

SHEET = ["file", "sheet"]
PREC = ["p_r1", "p_c1", "p_r2", "p_c2"]
DEP = ["d_r1", "d_c1", "d_r2", "d_c2"]
RECT = ["r1", "c1", "r2", "c2"]

# Pattern labels in order of preference.
RR_CHAIN, RR, RF, FR, FF, NO_COMP = "RR-Chain", "RR", "RF", "FR", "FF", "NoComp"
GAPS = ["RRGapOne", "RRGapTwo", "RRGapThree", "RRGapFour", "RRGapFive", "RRGapSix", "RRGapSeven"]
PATTERNS = [RR_CHAIN, RR, RF, FR, FF, *GAPS, NO_COMP]

# Edge types and directions.
EDGE_TYPES = ["ADD", "SUBTRACT", "MULTIPLY", "DIVIDE", "POWER", "COMPARE", "FUNCTION", "SETOPERATION", "OTHER"]
DIRECTIONS = ["TODOWN", "TORIGHT", "TOUP", "TOLEFT", "NODIRECTION"]

#: Limits of a sheet in a workbook, and the rows of a sheet made from a table, which may have more.
MAX_ROWS, MAX_COLS, TABLE_ROWS = 1_048_576, 16_384, 1 << 30

#: Cells of a run, or rows of a rectangle, that are listed at once.
PIECE = 1 << 16
