"""Lossless compression of raw edges into pattern edges, set-based.

A raw edge joins a precedent box to one dependent cell. Along a run of dependent cells (down a column or across a row) each pattern is an equality of a
few numbers, so runs are islands of consecutive cells with one key. They are found by sorting arrays, not by folding over formulas in turn:

1. down: for each edge, the length of its island under four patterns, and the best of these;
2. across: the same, and the choice: each edge takes its longest island; ties go to down before across, then to the corner flags' pattern if asked for, then RR, RF, FR, FF;
3. islands are numbered again among the edges that took the same pattern, since members may have left; each is one stored edge, those of one edge are NoComp;
4. if asked for, NoComp edges with equal RR keys at equal steps of 2 to 8 become gap runs.

Every raw edge is in exactly one stored edge. Edges are shuffled once, by (file, sheet, stretch of STRETCH rows), and read twice: a first pass lists the islands down that reach an end
of their stretch, which are put together on a narrow table of such ends; a second one, which has their whole lengths, does steps 1 to 3 for a stretch. A group is a stretch, 16,384
cells wide at most; so no group grows with the height of a sheet. Pieces of runs of neighbouring stretches are put together at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweft.functions.patterns import gap_step, offsets
from cellweft.functions.ranges import rect
from cellweft.model import FF, FR, GAPS, NO_COMP, PIECE, RF, RR, SHEET
from cellweft.operators.extract import distinct_edges
from cellweft.runtime import lanes, materialize


@dataclass(frozen=True)
class Options:
    """``in_row``: only formulas whose precedents all lie in their own row are compressed, and only downwards. ``dollar``: the corners' $ decide ties. ``gap``: gap
    runs are looked for. ``type_sensitive``: runs have one edge type."""

    in_row: bool = False
    dollar: bool = True
    gap: bool = False
    type_sensitive: bool = False


#: Patterns by code, in order of preference; NONE stands for NoComp.
CODES, NONE = [RR, RF, FR, FF], 4
#: Rows that are looked at together for gap runs across.
BLOCK_ROWS = 256
#: Rows that are looked at together for runs.
STRETCH = 512
_BOX = ["r1", "c1", "r2", "c2"]
_ABS = [f"abs_{k}" for k in _BOX]
_EDGE = ["dep_row", "dep_col", *_BOX]
_STORED = "file string, sheet string, p_r1 int, p_c1 int, p_r2 int, p_c2 int, d_r1 int, d_c1 int, d_r2 int, d_c2 int, pattern string, edge_type string, may boolean"
_STORED_BOXES = [f.split()[0] for f in _STORED.split(", ")[2:10]]
_ENDS = "file string, sheet string, stretch int, dep_col int, code int, k1 long, k2 long, kind string, may_run boolean, first int, last int"
_PACKED = ["at", "p1", "p2"]


class _Edges:
    """Columns of a group of edges as arrays."""

    def __init__(self, group: pa.Table, typed: bool) -> None:
        self.group, self.n = group, group.num_rows
        for name in _EDGE:
            setattr(self, name, group.column(name).to_numpy().astype(np.int64))
        types = group.column("edge_type").combine_chunks().dictionary_encode()
        types = types.combine_chunks() if isinstance(types, pa.ChunkedArray) else types
        self.types, self.names = types.indices.to_numpy(zero_copy_only=False).astype(np.int64), types.dictionary.to_pylist()
        self.kind = self.types if typed else np.zeros(self.n, np.int64)

    def flag(self, name: str) -> np.ndarray:
        return self.group.column(name).to_numpy(zero_copy_only=False).astype(bool)

    def keys(self, code: int, down: bool) -> tuple[np.ndarray, np.ndarray]:
        """What is equal for all edges of a run, besides the line: a number for each corner."""
        at, a1, a2, b1, b2 = (self.dep_row, self.r1, self.r2, self.c1, self.c2) if down else (self.dep_col, self.c1, self.c2, self.r1, self.r2)
        start = at - a1 if code in (0, 1) else a1
        end = at - a2 if code in (0, 2) else a2
        return start << 32 | b1, end << 32 | b2


def _sorted_islands(keys: list[np.ndarray], along: np.ndarray, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """An order in which islands (equal keys, ``along`` going up by ``step``) are together, and the places in it at which they start."""
    order = np.lexsort((along, *keys))
    if not len(order):
        return order, np.zeros(0, np.int64)
    new = np.diff(along[order], prepend=along[order[0]]) != step
    for k in keys:
        new |= np.diff(k[order], prepend=k[order[0]] - 1) != 0
    new[0] = True
    return order, np.nonzero(new)[0]


def _at_end(first: np.ndarray, last: np.ndarray, stretch: int) -> np.ndarray:
    """Whether intervals of rows reach an end of their stretch beyond which the sheet goes on."""
    return (first % stretch == 0) & (first > 0) | (last % stretch == stretch - 1)


def _ends(e: _Edges, p: int, may: np.ndarray, order: np.ndarray, first: np.ndarray, stretch: int) -> dict[tuple, int]:
    """Islands down that reach an end of the stretch, by (column, code, both keys, type, may, first row), each with its place among the islands."""
    rows = e.dep_row[order]
    at = np.nonzero(_at_end(rows[first], rows[np.r_[first[1:], e.n] - 1], stretch))[0] if e.n else first
    k1, k2 = e.keys(p, True)
    of = order[first[at]]
    types = [e.names[k] for k in e.types[of].tolist()] if e.kind is e.types else [""] * len(of)
    return dict(zip(zip(e.dep_col[of].tolist(), [p] * len(of), k1[of].tolist(), k2[of].tolist(), types, may[of].tolist(), e.dep_row[of].tolist()), at.tolist()))


def _best(e: _Edges, down: bool, may: np.ndarray, dollar: bool, whole: dict[tuple, int] | None = None, stretch: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Length and code of the best island of each edge in one direction; ``whole`` has the lengths of islands that go on beyond the stretch, by the keys of ``_ends``."""
    line, along = (e.dep_col, e.dep_row) if down else (e.dep_row, e.dep_col)
    length, code, score = np.ones(e.n, np.int64), np.full(e.n, NONE), np.full(e.n, -1, np.int64)
    fixed = [e.flag(f"abs_{'r' if down else 'c'}{k}") for k in (1, 2)] if dollar else []
    for p in range(4):
        order, first = _sorted_islands([*e.keys(p, down), e.kind, may.astype(np.int64), line], along)
        n = np.empty(e.n, np.int64)
        size = np.diff(np.r_[first, e.n])
        length_of = size.copy()
        if whole:
            for key, k in _ends(e, p, may, order, first, stretch).items():
                length_of[k] = whole.get(key, size[k])
        n[order] = np.repeat(length_of, size)
        n[~may] = 1
        hint = ((fixed[0] == (p in (2, 3))) & (fixed[1] == (p in (1, 3)))).astype(np.int64) if dollar else 0
        now = n * 8 + hint * 4 + 3 - p
        better = now > score
        length, code, score = np.where(better, n, length), np.where(better, p, code), np.where(better, now, score)
    return length, np.where(length > 1, code, NONE)


def _once(group: pa.Table, options: Options) -> tuple[_Edges, np.ndarray]:
    """Edges without repeats inside a formula (the one that comes first in its list stays), by rows, and whether they may be in runs."""
    packed = [group.column(k).to_numpy() for k in _PACKED]
    rest = group.column("rest").to_numpy()
    order = np.lexsort((rest, *reversed(packed)))
    packed = [x[order] for x in packed]
    new = np.zeros(len(order), bool)
    for x in packed:
        new |= np.diff(x, prepend=x[0] - 1) != 0
    order, packed = order[new], [x[new] for x in packed]
    corners = [y.astype(np.int32) for x in packed for y in (x >> 32, x & 0xFFFFFFFF)]
    flags = [(rest[order] >> k & 1).astype(bool) for k in range(4)]
    kept = [group.column(k).take(pa.array(order)) for k in (*SHEET, "edge_type")]
    e = _Edges(pa.table([*kept, *map(pa.array, corners), *map(pa.array, flags)], names=[*SHEET, "edge_type", *_EDGE, *_ABS]), options.type_sensitive)
    may = np.ones(e.n, bool)
    if options.in_row:
        cell = np.cumsum(np.diff(packed[0], prepend=-1) != 0) - 1
        may = np.bincount(cell, (e.r1 != e.dep_row) | (e.r2 != e.dep_row))[cell] == 0
    return e, may


def _open_ends(options: Options, stretch: int):
    """For each pattern, the islands down that reach an end of the stretch: their keys, first and last row."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.column("at").to_numpy() >> 32
        found = {k: [] for k in ("dep_col", "code", "k1", "k2", "kind", "may_run", "first", "last")}
        if _at_end(rows, rows, stretch).any():
            e, may = _once(group, options)
            for p in range(4):
                order, first = _sorted_islands([*e.keys(p, True), e.kind, may.astype(np.int64), e.dep_col], e.dep_row)
                last = e.dep_row[order[np.r_[first[1:], e.n] - 1]]
                for key, k in _ends(e, p, may, order, first, stretch).items():
                    for name, x in zip(found, (*key, int(last[k]))):
                        found[name].append(x)
        n = len(found["code"])
        where = [_strings(group.column(k)[0].as_py(), n) for k in SHEET]
        place = pa.array(np.full(n, int(rows[0]) // stretch, np.int32))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.int32())
        return pa.table([*where, place, *(pa.array(found[k], t) for k, t in zip(found, kinds))], names=[f.split()[0] for f in _ENDS.split(", ")])

    return run


def _islands(options: Options, stretch: int):
    """Stored edges of a stretch: the best island of each edge down and across, the choice, and the islands among edges of one pattern; with the keys of those
    that reach an end of the stretch. ``ends`` has the whole lengths of islands that go on beyond it."""

    def run(group: pa.Table, ends: pa.Table) -> pa.Table:
        e, may = _once(group, options)
        keys = [ends.column(k).to_pylist() for k in ("dep_col", "code", "k1", "k2", "kind", "may_run", "first")]
        n, code = _best(e, True, may, options.dollar, dict(zip(zip(*keys), ends.column("whole").to_pylist())), stretch)
        if options.in_row:
            return _lines(e, True, code, may, options, stretch)
        across, other = _best(e, False, may, options.dollar)
        down = n >= across
        parts = []
        for side, of in ((True, down), (False, ~down)):
            if of.any():
                parts.append(_lines(_Edges(e.group.filter(pa.array(of)), options.type_sensitive), side, (code if side else other)[of], may[of], options, stretch))
        return pa.concat_tables(parts)

    return run


def _strings(value: str, n: int) -> pa.Array:
    return pa.array([value]).take(pa.array(np.zeros(n, np.int64)))


def _stored(e: _Edges, order: np.ndarray, first: np.ndarray, patterns: np.ndarray, names: list[str], may: np.ndarray) -> pa.Table:
    """A stored edge for each island."""
    low = lambda x: pa.array(np.minimum.reduceat(x[order], first).astype(np.int32) if len(first) else np.zeros(0, np.int32))
    high = lambda x: pa.array(np.maximum.reduceat(x[order], first).astype(np.int32) if len(first) else np.zeros(0, np.int32))
    types = pa.array([*e.names, "OTHER"], pa.string())
    one, last = low(e.types).to_numpy(), high(e.types).to_numpy()
    kind = types.take(pa.array(np.where(one == last, one, len(types) - 1)))
    columns = [low(e.r1), low(e.c1), high(e.r2), high(e.c2), low(e.dep_row), low(e.dep_col), high(e.dep_row), high(e.dep_col)]
    of = pa.array(names, pa.string()).take(pa.array(patterns))
    where = [_strings(e.group.column(k)[0].as_py(), len(first)) if e.n else pa.array([], pa.string()) for k in SHEET]
    return pa.table([*where, *columns, of, kind, pa.array(may[order[first]])], names=[f.split()[0] for f in _STORED.split(", ")])


def _lines(e: _Edges, down: bool, code: np.ndarray, may: np.ndarray, options: Options, stretch: int) -> pa.Table:
    """Stored edges: islands among the edges of one pattern, with their keys, and whether they reach an end of the stretch."""
    line, along = (e.dep_col, e.dep_row) if down else (e.dep_row, e.dep_col)
    corners = [e.keys(p, down) for p in range(4)] + [(np.arange(e.n),) * 2]  # an edge without a pattern is an island of its own
    k1, k2 = (np.choose(code, [c[k] for c in corners]) for k in (0, 1))
    order, first = _sorted_islands([k1, k2, e.kind, may.astype(np.int64), code, line], along)
    size = np.diff(np.r_[first, e.n])
    out = _stored(e, order, first, np.where(size > 1, code[order[first]], NONE), [*CODES, NO_COMP], may)
    of = order[first]
    at_end = _at_end(along[of], along[order[first + size - 1]], stretch) & (code[of] != NONE) & may[of] if down else np.zeros(len(of), bool)
    for name, x in (("code", code[of].astype(np.int32)), ("k1", k1[of]), ("k2", k2[of]), ("at_end", at_end)):
        out = out.append_column(name, pa.array(x))
    return out


def compress(edges: DataFrame, options: Options = Options()) -> DataFrame:
    """Stored edges (EDGES_COMP) of raw edges; repeats inside a formula count once. Pieces of runs are written to the shared folder."""
    n, stretch = lanes(edges.sparkSession), STRETCH
    place = [*SHEET, "stretch"]
    packed = [F.shiftleft(F.col(a).cast("long"), 32).bitwiseOR(F.col(b).cast("long")).alias(k) for k, a, b in zip(_PACKED, _EDGE[::2], _EDGE[1::2])]
    rest = F.shiftleft(F.col("seq").cast("long"), 4)
    for k, flag in enumerate(_ABS):
        rest = rest.bitwiseOR(F.when(F.col(flag), 1 << k).otherwise(0).cast("long"))
    e = edges.select(*SHEET, *packed, rest.alias("rest"), "edge_type", F.expr(f"cast(dep_row div {stretch} as int) AS stretch")).repartition(n, *place)
    keys = ["dep_col", "code", "k1", "k2", "kind", "may_run"]
    ends = _whole(e.groupBy(*place).applyInArrow(_open_ends(options, stretch), _ENDS), keys, "first", "last")
    run = Window.partitionBy(*SHEET, *keys, "island")
    ends = ends.withColumn("whole", (F.max("last").over(run) - F.min("first").over(run) + 1).cast("long")).drop("island", "last")
    found = e.groupBy(*place).cogroup(ends.groupBy(*place)).applyInArrow(_islands(options, stretch), _STORED + ", code int, k1 long, k2 long, at_end boolean")
    found = materialize(found, "islands")
    e = found.where("not at_end").drop("code", "k1", "k2", "at_end").unionByName(_joined(found.where("at_end"), options))
    return with_offsets(_with_gaps(e, options) if options.gap else e)


def _whole(ends: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
    """Pieces of runs of one key with ``island``, which is the same for pieces that follow each other."""
    line = Window.partitionBy(*SHEET, *keys).orderBy(first)
    new = F.coalesce(F.lag(last).over(line) + 1 != F.col(first), F.lit(True)).cast("int")
    return ends.withColumn("new", new).withColumn("island", F.sum("new").over(line)).drop("new")


def _joined(pieces: DataFrame, options: Options) -> DataFrame:
    """Stored edges of the pieces that runs have in neighbouring stretches."""
    kind = ["edge_type"] if options.type_sensitive else []
    pieces = _whole(pieces, ["d_c1", "code", "k1", "k2", *kind], "d_r1", "d_r2")
    corners = [f(k).alias(k) for k, f in zip(_STORED_BOXES, [F.min, F.min, F.max, F.max] * 2)]
    one = F.when(F.min("edge_type") == F.max("edge_type"), F.min("edge_type")).otherwise("OTHER").alias("one_type")
    runs = pieces.groupBy(*SHEET, F.col("d_c1").alias("of_col"), "code", "k1", "k2", "island", *[F.col(k).alias("of_kind") for k in kind]).agg(*corners, one)
    pattern = F.when(F.col("d_r1") == F.col("d_r2"), NO_COMP).otherwise(F.get(F.array(*map(F.lit, CODES)), "code"))
    return runs.select(*SHEET, *_STORED_BOXES, pattern.alias("pattern"), F.col("one_type").alias("edge_type"), F.lit(True).alias("may"))


def with_offsets(stored: DataFrame) -> DataFrame:
    """Stored edges with the offsets that follow from their boxes and pattern."""
    p, d = rect("p_r1", "p_c1", "p_r2", "p_c2"), rect("d_r1", "d_c1", "d_r2", "d_c2")
    stored = stored.withColumns({k: c.cast("int") for k, c in offsets(p, d, F.col("pattern")).items()})
    return stored.select(*SHEET, "p_r1", "p_c1", "p_r2", "p_c2", "d_r1", "d_c1", "d_r2", "d_c2", "pattern", "so_r", "so_c", "eo_r", "eo_c", "edge_type")


def _gap_runs(positions: list[int]) -> list[tuple[int, int]]:
    """(run, step) of each position, left to right: a position extends the run that ends 2 to 8 before it, the nearest first, and that has this step or is one cell; step 0 stays alone."""
    ends: dict[int, int] = {}
    steps: list[int] = []
    member = []
    for x in positions:
        for step in range(2, 9):
            run = ends.get(x - step)
            if run is not None and steps[run] in (0, step):
                steps[run] = step
                del ends[x - step]
                break
        else:
            run = len(steps)
            steps.append(0)
        ends[x] = run
        member.append(run)
    return [(run, steps[run]) for run in member]


def _gap_islands(down: bool):
    """Gap runs of one line or block of lines, as stored edges; edges that are in none come back as they are."""

    def run(group: pa.Table) -> pa.Table:
        names = dict(zip(("p_r1", "p_c1", "p_r2", "p_c2", "d_r1", "d_c1"), ("r1", "c1", "r2", "c2", "dep_row", "dep_col")))
        e = _Edges(group.rename_columns([names.get(c, c) for c in group.column_names]), False)
        line, along = (e.dep_col, e.dep_row) if down else (e.dep_row, e.dep_col)
        keys = [*e.keys(0, down), line]
        order = np.lexsort((along, *keys))
        new = np.zeros(e.n, bool)
        for k in keys:
            new |= np.diff(k[order], prepend=k[order[0]] - 1) != 0
        first = np.nonzero(new)[0]
        run_of, step_of = np.arange(e.n), np.zeros(e.n, np.int64)
        for a, b in zip(first, np.r_[first[1:], e.n]):
            if b - a > 1:
                found = np.array(_gap_runs(along[order[a:b]].tolist()))
                run_of[a:b], step_of[a:b] = a + found[:, 0], found[:, 1]
        # run numbers are places of a key's range in the order, so they are distinct
        again = np.argsort(run_of, kind="stable")
        starts = np.nonzero(np.diff(run_of[again], prepend=-1) != 0)[0]
        steps = step_of[again][starts]
        return _stored(e, order[again], starts, np.where(steps > 0, steps - 2, len(GAPS)), [*GAPS, NO_COMP], e.flag("may"))

    return run


def _with_gaps(e: DataFrame, options: Options) -> DataFrame:
    """Turn NoComp edges at equal steps into gap runs, down first, then across."""
    for down in (True,) if options.in_row else (True, False):
        is_open = (F.col("pattern") == NO_COMP) & F.col("may")
        line = F.col("d_c1") if down else F.expr(f"d_r1 div {BLOCK_ROWS}").cast("int")
        left = e.where(is_open).withColumn("line", line).repartition(lanes(e.sparkSession), *SHEET, "line").groupBy(*SHEET, "line")
        e = e.where(~is_open).unionByName(left.applyInArrow(_gap_islands(down), _STORED))
    return e


def expand(stored: DataFrame, also: list[str] | None = None) -> DataFrame:
    """The raw edges of stored ones: file, sheet, dep_row, dep_col, r1, c1, r2, c2, edge_type, and columns ``also``. The inverse of ``compress`` but for order and $."""
    down, step = F.col("d_c1") == F.col("d_c2"), gap_step(F.col("pattern"))
    runs = stored.withColumns({"down": down, "step": step, "first": F.when(down, F.col("d_r1")).otherwise(F.col("d_c1")), "last": F.when(down, F.col("d_r2")).otherwise(F.col("d_c2"))})
    long = F.expr(f"(last - first) div step >= {PIECE}")
    pieces = runs.where(long).withColumn("first", F.explode(F.expr(f"sequence(first, last, step * {PIECE})"))).withColumn("last", F.expr(f"least(last, first + step * {PIECE - 1})"))
    runs = runs.where(~long).unionByName(pieces.repartition(lanes(stored.sparkSession)))
    cells = runs.withColumn("k", F.explode(F.sequence("first", "last", "step")))
    cells = cells.withColumns({"dep_row": F.when(F.col("down"), F.col("k")).otherwise(F.col("d_r1")), "dep_col": F.when(F.col("down"), F.col("d_c1")).otherwise(F.col("k"))})
    pattern = F.col("pattern")
    start, end = pattern.isin(RR, RF, *GAPS), pattern.isin(RR, FR, *GAPS)
    return cells.select(
        *SHEET, "dep_row", "dep_col",
        F.when(start, F.col("dep_row") - F.col("so_r")).otherwise(F.col("p_r1")).alias("r1"),
        F.when(start, F.col("dep_col") - F.col("so_c")).otherwise(F.col("p_c1")).alias("c1"),
        F.when(end, F.col("dep_row") - F.col("eo_r")).otherwise(F.col("p_r2")).alias("r2"),
        F.when(end, F.col("dep_col") - F.col("eo_c")).otherwise(F.col("p_c2")).alias("c2"),
        "edge_type", *(also or []),
    )


def as_stored(edges: DataFrame, once: bool = False) -> DataFrame:
    """Raw edges in the form of stored ones, uncompressed; ``once`` says that none is there twice."""
    e = edges if once else distinct_edges(edges)
    stored = e.select(*SHEET, F.col("r1").alias("p_r1"), F.col("c1").alias("p_c1"), F.col("r2").alias("p_r2"), F.col("c2").alias("p_c2"), F.col("dep_row").alias("d_r1"), F.col("dep_col").alias("d_c1"), F.col("dep_row").alias("d_r2"), F.col("dep_col").alias("d_c2"), F.lit(NO_COMP).alias("pattern"), "edge_type")
    return with_offsets(stored)


__all__ = ["Options", "as_stored", "compress", "expand", "with_offsets"]
