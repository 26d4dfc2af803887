"""Compression patterns: predicates on neighbouring edges, offsets, and the maps from one end of an edge to the other.

With P and D the precedent and dependent boxes of a stored edge, an input x inside P is mapped forward, and an input y inside D backward.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellweft.functions.ranges import overlap, rect
from cellweft.model import FR, GAPS, RF, RR


def is_rr(last: Column, prec: Column, dr: int, dc: int) -> Column:
    """Both corners move with the dependent cell."""
    return (prec.r1 == last.r1 + dr) & (prec.c1 == last.c1 + dc) & (prec.r2 == last.r2 + dr) & (prec.c2 == last.c2 + dc)


def is_rf(last: Column, prec: Column, dr: int, dc: int) -> Column:
    """The start corner moves, the end corner is fixed."""
    return (prec.r1 == last.r1 + dr) & (prec.c1 == last.c1 + dc) & (prec.r2 == last.r2) & (prec.c2 == last.c2)


def is_fr(last: Column, prec: Column, dr: int, dc: int) -> Column:
    """The start corner is fixed, the end corner moves."""
    return (prec.r1 == last.r1) & (prec.c1 == last.c1) & (prec.r2 == last.r2 + dr) & (prec.c2 == last.c2 + dc)


def is_ff(last: Column, prec: Column) -> Column:
    return (prec.r1 == last.r1) & (prec.c1 == last.c1) & (prec.r2 == last.r2) & (prec.c2 == last.c2)


def is_rr_chain(last: Column, prec: Column, dep: Column, dr: int, dc: int) -> Column:
    """RR in which the precedent is the cell just before the dependent."""
    return is_rr(last, prec, dr, dc) & (dep.r1 == prec.r1 + dr) & (dep.c1 == prec.c1 + dc) & (dep.r2 == prec.r2 + dr) & (dep.c2 == prec.c2 + dc)


def corner_is_relative(abs_row: Column, abs_col: Column, vertical: bool) -> Column:
    """Whether a corner moves along a run: it has no $ on the axis of the run."""
    return ~(abs_row if vertical else abs_col)


def gap_step(pattern: Column) -> Column:
    """Distance between dependent cells of a gap pattern; 1 for others."""
    return F.coalesce(F.element_at(F.create_map(*[x for k, g in enumerate(GAPS) for x in (F.lit(g), F.lit(k + 2))]), pattern), F.lit(1))


def gap_label(step: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, GAPS)), step.cast("int") - 1)


def offsets(p: Column, d: Column, pattern: Column) -> dict[str, Column]:
    """Stored offsets, dependent minus precedent: both corners for RR and gaps, the start's for RF, the end's for FR, 0 for others."""
    start, end = pattern.isin(RR, RF, *GAPS), pattern.isin(RR, FR, *GAPS)
    zero = F.lit(0)
    return {
        "so_r": F.when(start, d.r1 - p.r1).otherwise(zero),
        "so_c": F.when(start, d.c1 - p.c1).otherwise(zero),
        "eo_r": F.when(end, d.r2 - p.r2).otherwise(zero),
        "eo_c": F.when(end, d.c2 - p.c2).otherwise(zero),
    }


def _edge(alias: str):
    col = lambda name: F.col(f"{alias}.{name}" if alias else name)
    return rect(col("p_r1"), col("p_c1"), col("p_r2"), col("p_c2")), rect(col("d_r1"), col("d_c1"), col("d_r2"), col("d_c2")), col


def forward(x: Column, alias: str = "", chains: bool = False) -> Column:
    """The rectangle of D that depends on x (inside P); for gap patterns, the window in which the dependents lie.

    The axis across the run is widened to P first. With ``chains``, a run whose formulas read the cell just before gives all that follows.
    """
    p, d, col = _edge(alias)
    down = d.c1 == d.c2
    x = F.when(down, rect(x.r1, p.c1, x.r2, p.c2)).otherwise(rect(p.r1, x.c1, p.r2, x.c2))
    pattern = col("pattern")
    moves = pattern.isin(RR, *GAPS)
    r1 = F.when(moves | (pattern == FR), x.r1 + col("eo_r")).otherwise(d.r1)
    c1 = F.when(moves | (pattern == FR), x.c1 + col("eo_c")).otherwise(d.c1)
    r2 = F.when(moves | (pattern == RF), x.r2 + col("so_r")).otherwise(d.r2)
    c2 = F.when(moves | (pattern == RF), x.c2 + col("so_c")).otherwise(d.c2)
    if chains:
        kind = chain_kind(alias)
        r1, c1 = F.when(kind == "up", d.r1).otherwise(r1), F.when(kind == "left", d.c1).otherwise(c1)
        r2, c2 = F.when(kind == "down", d.r2).otherwise(r2), F.when(kind == "right", d.c2).otherwise(c2)
    return overlap(rect(r1, c1, r2, c2), d)


def backward(y: Column, alias: str = "", chains: bool = False) -> Column:
    """The rectangle of P on which y (inside D) depends. With ``chains``, a run whose formulas read the cell just before gives all before."""
    p, d, col = _edge(alias)
    pattern = col("pattern")
    moves = pattern.isin(RR, *GAPS)
    r1 = F.when(moves | (pattern == RF), y.r1 - col("so_r")).otherwise(p.r1)
    c1 = F.when(moves | (pattern == RF), y.c1 - col("so_c")).otherwise(p.c1)
    r2 = F.when(moves | (pattern == FR), y.r2 - col("eo_r")).otherwise(p.r2)
    c2 = F.when(moves | (pattern == FR), y.c2 - col("eo_c")).otherwise(p.c2)
    if chains:
        kind = chain_kind(alias)
        r1, c1 = F.when(kind == "down", p.r1).otherwise(r1), F.when(kind == "right", p.c1).otherwise(c1)
        r2, c2 = F.when(kind == "up", p.r2).otherwise(r2), F.when(kind == "left", p.c2).otherwise(c2)
    return overlap(rect(r1, c1, r2, c2), p)


def chain_kind(alias: str = "") -> Column:
    """The direction in which an RR run depends on itself step by step: its nearest precedent is the cell just before; else null.

    The transitive closure inside such a run is everything after the input (forward) or before it (backward), in one step.
    """
    p, d, col = _edge(alias)
    own_col = (p.c1 == d.c1) & (p.c2 == d.c1) & (d.c1 == d.c2)
    own_row = (p.r1 == d.r1) & (p.r2 == d.r1) & (d.r1 == d.r2)
    return F.when(
        col("pattern") == RR,
        F.when(own_col & (col("eo_r") == 1), F.lit("down")).when(own_col & (col("so_r") == -1), F.lit("up")).when(own_row & (col("eo_c") == 1), F.lit("right")).when(own_row & (col("so_c") == -1), F.lit("left")),
    )


