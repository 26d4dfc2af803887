"""Range algebra as Column expressions.

A rectangle is a struct (r1, c1, r2, c2) of 0-based inclusive corners. All functions are built-in expressions, so they stay in generated
code. A null rectangle gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RECT_TYPE = "struct<r1:int,c1:int,r2:int,c2:int>"


def rect(r1, c1, r2=None, c2=None) -> Column:
    """A rectangle from four columns or numbers; of two, a cell."""
    lift = lambda x: (F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)).cast("int")
    r2, c2 = r1 if r2 is None else r2, c1 if c2 is None else c2
    return F.struct(lift(r1).alias("r1"), lift(c1).alias("c1"), lift(r2).alias("r2"), lift(c2).alias("c2"))


def is_valid(a: Column) -> Column:
    return (a.r1 >= 0) & (a.c1 >= 0) & (a.r1 <= a.r2) & (a.c1 <= a.c2)


def is_cell(a: Column) -> Column:
    return (a.r1 == a.r2) & (a.c1 == a.c2)


def cell_count(a: Column) -> Column:
    """Area as BIGINT."""
    return (a.r2 - a.r1 + F.lit(1).cast("long")) * (a.c2 - a.c1 + F.lit(1).cast("long"))


def overlaps(a: Column, b: Column) -> Column:
    return (a.r1 <= b.r2) & (b.r1 <= a.r2) & (a.c1 <= b.c2) & (b.c1 <= a.c2)


def contains(large: Column, small: Column) -> Column:
    return (large.r1 <= small.r1) & (large.c1 <= small.c1) & (large.r2 >= small.r2) & (large.c2 >= small.c2)


def overlap(a: Column, b: Column) -> Column:
    """Intersection, or null."""
    return F.when(overlaps(a, b), rect(F.greatest(a.r1, b.r1), F.greatest(a.c1, b.c1), F.least(a.r2, b.r2), F.least(a.c2, b.c2)))


def bounding_box(a: Column, b: Column) -> Column:
    return rect(F.least(a.r1, b.r1), F.least(a.c1, b.c1), F.greatest(a.r2, b.r2), F.greatest(a.c2, b.c2))


def non_overlap(a: Column, b: Column) -> Column:
    """``a`` without ``b`` as an array of at most four rectangles: left (full height), up, down, right; all of ``a`` if they are disjoint."""
    x = overlap(a, b)
    mid1, mid2 = x.c1, x.c2
    parts = [
        F.when(a.c1 < x.c1, rect(a.r1, a.c1, a.r2, x.c1 - 1)),
        F.when(a.r1 < x.r1, rect(a.r1, mid1, x.r1 - 1, mid2)),
        F.when(x.r2 < a.r2, rect(x.r2 + 1, mid1, a.r2, mid2)),
        F.when(x.c2 < a.c2, rect(a.r1, x.c2 + 1, a.r2, a.c2)),
    ]
    return F.when(x.isNull(), F.array(a)).otherwise(F.array_compact(F.array(*parts)))


def subtract_all(a: Column, others: Column) -> Column:
    """``a`` without all rectangles of an array, as an array of disjoint ones."""
    return F.aggregate(others, F.array(a), lambda left, b: F.flatten(F.transform(left, lambda x: non_overlap(x, b))))


def offset(prec: Column, dep: Column, start: bool = True) -> Column:
    """Dependent minus precedent, on the start or the end corners: (row, col)."""
    r, c = ("r1", "c1") if start else ("r2", "c2")
    return F.struct((dep[r] - prec[r]).alias("row"), (dep[c] - prec[c]).alias("col"))


# What a step in each direction adds to (row, column).
_STEPS = {"TODOWN": (1, 0), "TORIGHT": (0, 1), "TOUP": (-1, 0), "TOLEFT": (0, -1)}


def shift(a: Column, direction: str, step: int = 1) -> Column:
    """``a`` moved; null if it stands at row 0 and would go up, or at column 0 and would go left."""
    dr, dc = _STEPS[direction]
    moved = rect(a.r1 + dr * step, a.c1 + dc * step, a.r2 + dr * step, a.c2 + dc * step)
    return moved if direction in ("TODOWN", "TORIGHT") else F.when((a.r1 if dr else a.c1) > 0, moved)


def adjacency(a: Column, b: Column, step: int = 1) -> Column:
    """The direction of ``a`` as seen from ``b``, if it is ``step`` away with equal extent on the other axis; else NODIRECTION."""
    same_rows, same_cols = (a.r1 == b.r1) & (a.r2 == b.r2), (a.c1 == b.c1) & (a.c2 == b.c2)
    return (
        F.when(same_rows & (b.c1 - a.c2 == step), F.lit("TOLEFT"))
        .when(same_rows & (a.c1 - b.c2 == step), F.lit("TORIGHT"))
        .when(same_cols & (b.r1 - a.r2 == step), F.lit("TOUP"))
        .when(same_cols & (a.r1 - b.r2 == step), F.lit("TODOWN"))
        .otherwise(F.lit("NODIRECTION"))
    )


def is_adjacent(a: Column, b: Column, step: int = 1) -> Column:
    return adjacency(a, b, step) != "NODIRECTION"


def split_by_cell(dep: Column, row: Column, col: Column) -> Column:
    """A run of one row or column without one of its cells: an array of up to two rectangles."""
    down = dep.c1 == dep.c2
    before = F.when(down, rect(dep.r1, dep.c1, row - 1, dep.c2)).otherwise(rect(dep.r1, dep.c1, dep.r2, col - 1))
    after = F.when(down, rect(row + 1, dep.c1, dep.r2, dep.c2)).otherwise(rect(dep.r1, col + 1, dep.r2, dep.c2))
    return F.filter(F.array(before, after), is_valid)


def column_number(letters: Column) -> Column:
    """0-based index of a column label."""
    codes = F.transform(F.split(F.upper(letters), ""), lambda x: F.ascii(x) - 64)
    return F.aggregate(F.filter(codes, lambda k: k > 0), F.lit(0), lambda n, k: n * 26 + k) - 1


def cell_of(text: Column) -> Column:
    """The cell that ``Sheet:N2`` (or ``N2``) names, as a rectangle; null if it names none."""
    name = F.element_at(F.split(text, ":"), -1)
    letters, digits = F.regexp_extract(name, r"^([A-Za-z]{1,3})([0-9]{1,7})$", 1), F.regexp_extract(name, r"^([A-Za-z]{1,3})([0-9]{1,7})$", 2)
    row, col = F.expr("0") + F.try_to_number(digits, F.lit("9999999")).cast("int") - 1, column_number(letters)
    return F.when(letters != "", rect(row, col))


def column_label(index: Column) -> Column:
    """Label of a 0-based column index, for any number of letters up to three."""
    letter = lambda n: F.char(n + 65)
    one = letter(index)
    two = F.concat(letter(F.floor((index - 26) / 26).cast("int")), letter((index - 26) % 26))
    three = F.concat(letter(F.floor((index - 702) / 676).cast("int")), letter((F.floor((index - 702) / 26) % 26).cast("int")), letter((index - 702) % 26))
    return F.when(index < 26, one).when(index < 702, two).otherwise(three)


def to_text(a: Column) -> Column:
    """``A1``, or ``(A1:B2)``."""
    first, last = F.concat(column_label(a.c1), (a.r1 + 1).cast("string")), F.concat(column_label(a.c2), (a.r2 + 1).cast("string"))
    return F.when(is_cell(a), first).otherwise(F.concat(F.lit("("), first, F.lit(":"), last, F.lit(")")))
