"""Dependents and precedents of ranges, direct and transitive, on stored or raw edges.

Queries are a table (qid, file, sheet, r1, c1, r2, c2); many are answered at once. The engine maps rectangles by column arithmetic and never expands a stored edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweft.functions.patterns import backward, forward, gap_step
from cellweft.functions.ranges import is_valid, overlap, overlaps, rect
from cellweft.model import GAPS, PIECE, SHEET
from cellweft.runtime import discard, lanes, materialize

QUERY = "qid long, file string, sheet string, r1 int, c1 int, r2 int, c2 int"
#: Query rows up to which each stored edge is compared with all of its sheet, and up to which they may be broadcast in the interval join.
FEW, SOME = 64, 20_000
#: Keyed rows of a side that may be broadcast in the interval join, and rows of long intervals that are.
SENT, FEW_LONG = 100_000, 1_000


def queries(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A query table from (qid, file, sheet, r1, c1, r2, c2) tuples. Queries that are no rectangle of a sheet are dropped: they have no result."""
    return spark.createDataFrame(rows, QUERY).where(is_valid(rect("r1", "c1", "r2", "c2")))


def _level(first: str, last: str) -> Column:
    """The dyadic level of an interval: a bucket of it is as long as the interval, or up to twice."""
    return F.ceil(F.log2((F.col(last) - F.col(first) + 1).cast("double"))).cast("int")


def _buckets(first: str, last: str, levels: list[int] | None) -> Column:
    """(level, bucket) of a point on each of ``levels``; without these, the one or two that cover an interval, on its own level."""
    if levels is not None:
        return F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(first, k).alias("bucket")) for k in levels])
    level = _level(first, last)
    at = lambda x: F.struct(level.alias("level"), F.expr(f"shiftright({x}, cast(ceil(log2(cast({last} - {first} + 1 as double))) as int))").alias("bucket"))
    return F.array_distinct(F.array(at(first), at(last)))


def _keyed(df: DataFrame, box: tuple[str, str, str, str], rows: list[int] | None, cols: list[int] | None, prefix: str) -> DataFrame:
    r1, c1, r2, c2 = box
    df = df.withColumn(f"{prefix}row_key", F.explode(_buckets(r1, r2, rows)))
    return df.withColumn(f"{prefix}col_key", F.explode(_buckets(c1, c2, cols)))


def _level_counts(df: DataFrame, box: tuple[str, str, str, str], side: str) -> DataFrame:
    r1, c1, r2, c2 = box
    return df.groupBy(F.lit(side).alias("side"), _level(r1, r2).alias("rows"), _level(c1, c2).alias("cols")).count()


def interval_join(a: DataFrame, b: DataFrame, a_rect: tuple[str, str, str, str], b_rect: tuple[str, str, str, str], small: bool = False) -> DataFrame:
    """Pairs of rows of ``a`` and ``b`` of one file and sheet whose rectangles overlap, by equi-joins on dyadic buckets of rows and of columns.

    Two intervals overlap if the first place of one lies in the other: ``a``'s in ``b``'s, or ``b``'s, when it is the later one, in ``a``'s. A point meets one
    bucket on each level, an interval at most two buckets on its own; so the join is a join on keys, whatever the sizes, and a sheet's
    rows spread over many keys. Both axes are in the key: a column of long ranges meets only what stands in its columns. A first pass counts the levels on either side: points go to
    those that occur only, and a way to overlap that cannot occur (cells hold no later place) is left out.

    Joins are sort-merge joins, however small the files are that the tables come from: a compressed file of a few MB can be a table that no driver holds. Broadcast are, as counted,
    ``b``'s rows of levels that have few (long runs, which would gather all points at one key), and, with ``small``, ``a``, if it is small with all its keys.
    """
    b = b.withColumnsRenamed({k: f"b_{k}" for k in SHEET})
    counts = _level_counts(a, a_rect, "a").unionByName(_level_counts(b, b_rect, "b")).collect()  # some 30 x 15 rows a side at most
    a_rows, a_cols, b_rows, b_cols = (sorted({r[k] for r in counts if r["side"] == side}) for side in "ab" for k in ("rows", "cols"))
    n_a, left = sum(r["count"] for r in counts if r["side"] == "a"), FEW_LONG
    few = []
    for k in reversed(b_rows):
        n = sum(r["count"] for r in counts if r["side"] == "b" and r["rows"] == k)
        if n <= left:
            left -= n
            few.append(k)
    (ar1, ac1, ar2, ac2), (br1, bc1, br2, bc2) = a_rect, b_rect
    level = _level(br1, br2)
    extra = ["row_key", "col_key", "b_row_key", "b_col_key", "b_file", "b_sheet"]

    def joined(y: DataFrame, levels: list[int], row_in_b: bool, col_in_b: bool, sent: bool) -> DataFrame:
        x = _keyed(a, a_rect, levels if row_in_b else None, b_cols if col_in_b else None, "")
        y = _keyed(y, b_rect, None if row_in_b else a_rows, None if col_in_b else a_cols, "b_")
        most = n_a * (len(levels) if row_in_b else 2) * (len(b_cols) if col_in_b else 2)
        if small and most <= SENT:
            x = F.broadcast(x)
        elif sent:
            y = F.broadcast(y)
        else:
            y = y.hint("merge")
        down = F.col(ar1).between(F.col(br1), F.col(br2)) if row_in_b else (F.col(br1) > F.col(ar1)) & (F.col(br1) <= F.col(ar2))
        across = F.col(ac1).between(F.col(bc1), F.col(bc2)) if col_in_b else (F.col(bc1) > F.col(ac1)) & (F.col(bc1) <= F.col(ac2))
        key = (x["file"] == y["b_file"]) & (x["sheet"] == y["b_sheet"])
        for k in ("row_key", "col_key"):
            key &= (x[k]["level"] == y[f"b_{k}"]["level"]) & (x[k]["bucket"] == y[f"b_{k}"]["bucket"])
        return y.join(x, key & down & across).drop(*extra)

    many = [k for k in b_rows if k not in few]
    parts = []
    for col_in_b in (True, False):
        if not col_in_b and a_cols == [0]:
            continue
        if many:
            parts.append(joined(b.where(~level.isin(few)) if few else b, many, True, col_in_b, False))
        if few:
            parts.append(joined(b.where(level.isin(few)) if many else b, few, True, col_in_b, True))
        if a_rows != [0]:
            parts.append(joined(b, b_rows, False, col_in_b, not many))
    if not parts:
        parts = [joined(b, [0], True, True, False)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _overlapping(q: DataFrame, stored: DataFrame, side: str, rows: int) -> DataFrame:
    """Stored edges that overlap queries; ``rows`` is the number of these, or a bound of it."""
    box = [f"{side}_{k}" for k in ("r1", "c1", "r2", "c2")]
    if rows > FEW:
        return interval_join(q, stored, ("r1", "c1", "r2", "c2"), tuple(box), rows <= SOME)
    q = F.broadcast(q.withColumnsRenamed({k: f"q_{k}" for k in SHEET}))
    hit = overlaps(rect("r1", "c1", "r2", "c2"), rect(*box))
    return stored.join(q, (q["q_file"] == stored["file"]) & (q["q_sheet"] == stored["sheet"]) & hit).drop("q_file", "q_sheet")


def _mapped(hits: DataFrame, side: str, chains: bool) -> DataFrame:
    """Each hit mapped through its edge: ``x`` the clipped input, ``y`` the result."""
    box = rect(*[f"{side}_{k}" for k in ("r1", "c1", "r2", "c2")])
    hits = hits.withColumn("x", overlap(rect("r1", "c1", "r2", "c2"), box))
    step = gap_step(F.col("pattern"))
    down = F.col("d_c1") == F.col("d_c2")
    d1, along = F.when(down, F.col("d_r1")).otherwise(F.col("d_c1")), lambda c, k: F.when(down, c[f"r{k}"]).otherwise(c[f"c{k}"])
    if side == "d":  # an input between the cells of a gap run is no dependent of it
        first = d1 + F.ceil((along(F.col("x"), 1) - d1) / step).cast("int") * step
        last = d1 + F.floor((along(F.col("x"), 2) - d1) / step).cast("int") * step
        cells = F.when(first <= last, F.sequence(first, last, step)).otherwise(F.array().cast("array<int>"))
        pieces = F.transform(cells, lambda k: F.when(down, rect(k, F.col("d_c1"), k, F.col("d_c1"))).otherwise(rect(F.col("d_r1"), k, F.col("d_r1"), k)))
        hits = hits.withColumn("x", F.explode(F.when(F.col("pattern").isin(*GAPS), pieces).otherwise(F.array("x"))))
        return hits.withColumn("y", backward(F.col("x"), chains=chains)).where("y is not null")
    hits = hits.withColumn("y", forward(F.col("x"), chains=chains)).where("y is not null")
    first = d1 + F.ceil((along(F.col("y"), 1) - d1) / step).cast("int") * step
    last = d1 + F.floor((along(F.col("y"), 2) - d1) / step).cast("int") * step
    cells = F.when(first <= last, F.sequence(first, last, step)).otherwise(F.array().cast("array<int>"))
    pieces = F.transform(cells, lambda k: F.when(down, rect(k, F.col("d_c1"), k, F.col("d_c1"))).otherwise(rect(F.col("d_r1"), k, F.col("d_r1"), k)))
    return hits.withColumn("y", F.explode(F.when(F.col("pattern").isin(*GAPS), pieces).otherwise(F.array("y"))))


def _direct(q: DataFrame, stored: DataFrame, side: str, small: bool) -> DataFrame:
    hits = _mapped(_overlapping(q, stored, side, 0 if small else SOME + 1), side, False)
    prec, dep = ("x", "y") if side == "p" else ("y", "x")
    start = F.col("pattern").isin("RR", "RF", *GAPS)
    end = F.col("pattern").isin("RR", "FR", *GAPS)
    cut = lambda on, k: F.when(on, F.col(dep)[k] - F.col(prec)[k]).otherwise(0)
    return hits.select("qid", *SHEET, F.col("x").alias("of"), F.col("y").alias("ref"), "pattern", cut(start, "r1").alias("so_r"), cut(start, "c1").alias("so_c"), cut(end, "r2").alias("eo_r"), cut(end, "c2").alias("eo_c"), "edge_type")


def direct_dependents(q: DataFrame, stored: DataFrame, small: bool = True) -> DataFrame:
    """Edges from the queried ranges: qid, file, sheet, of (the part of the query that an edge starts from), ref (its dependents), pattern, offsets of that part, edge_type.

    ``small`` says that the query table is to be broadcast; otherwise both sides are spread by the interval join.
    """
    return _direct(q, stored, "p", small)


def direct_precedents(q: DataFrame, stored: DataFrame, small: bool = True) -> DataFrame:
    """Edges into the queried ranges, as ``direct_dependents``: of is the queried part, ref what it depends on."""
    return _direct(q, stored, "d", small)


def lines(rects: DataFrame) -> DataFrame:
    """Rectangles (qid, file, sheet, r1, c1, r2, c2) as merged row intervals per column: qid, file, sheet, col, r1, r2."""
    cells = rects.select("qid", *SHEET, F.explode(F.sequence("c1", "c2")).alias("col"), "r1", "r2")
    line = Window.partitionBy("qid", *SHEET, "col").orderBy("r1", "r2")
    before = F.max("r2").over(line.rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.withColumn("new", (before.isNull() | (F.col("r1") > before + 1)).cast("int")).withColumn("island", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return cells.groupBy("qid", *SHEET, "col", "island").agg(F.min("r1").alias("r1"), F.max("r2").alias("r2")).drop("island")


def subtract_lines(a: DataFrame, b: DataFrame) -> DataFrame:
    """The parts of line intervals ``a`` that no interval of ``b`` covers, by a sweep over both ends of all intervals of a column."""
    ends = lambda df, x, y: df.select("qid", *SHEET, "col", F.explode(F.array(F.struct(F.col("r1").alias("at"), F.lit(x).alias("a"), F.lit(y).alias("b")), F.struct((F.col("r2") + 1).alias("at"), F.lit(-x).alias("a"), F.lit(-y).alias("b")))).alias("e")).select("qid", *SHEET, "col", "e.*")
    events = ends(a, 1, 0).unionByName(ends(b, 0, 1)).groupBy("qid", *SHEET, "col", "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    line = Window.partitionBy("qid", *SHEET, "col").orderBy("at")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    swept = events.select("qid", *SHEET, "col", F.col("at").alias("r1"), (F.lead("at").over(line) - 1).alias("r2"), F.sum("a").over(upto).alias("in_a"), F.sum("b").over(upto).alias("in_b"))
    return swept.where("in_a > 0 and in_b = 0 and r2 >= r1").drop("in_a", "in_b")


def _closure(q: DataFrame, stored: DataFrame, side: str, max_levels: int, chains: bool) -> DataFrame:
    def boxed(df: DataFrame) -> DataFrame:
        return df.select("qid", *SHEET, "r1", F.col("col").alias("c1"), "r2", F.col("col").alias("c2"))

    frontier, rows = q, q.count()
    covered: DataFrame | None = None
    for _ in range(max_levels):
        hits = _mapped(_overlapping(frontier, stored, side, rows), side, chains)
        reached = lines(hits.select("qid", *SHEET, "y.*"))
        new = materialize(lines(boxed(subtract_lines(reached, covered))) if covered is not None else reached, "closure")
        rows = new.count()
        if not rows:
            discard(new)
            break
        union = new if covered is None else materialize(lines(boxed(covered.unionByName(new))), "closure")
        covered, frontier = union, boxed(new)
    else:
        raise RuntimeError(f"the closure goes on after {max_levels} levels")
    if covered is None:
        covered = q.sparkSession.createDataFrame([], "qid long, file string, sheet string, r1 int, r2 int, col int")
    return merge_lines(covered)


def merge_lines(covered: DataFrame) -> DataFrame:
    """Line intervals as disjoint rectangles: equal intervals of neighbouring columns are one."""
    across = Window.partitionBy("qid", *SHEET, "r1", "r2").orderBy("col")
    islands = covered.withColumn("island", F.col("col") - F.row_number().over(across))
    out = islands.groupBy("qid", *SHEET, "r1", "r2", "island").agg(F.min("col").alias("c1"), F.max("col").alias("c2"))
    return out.select("qid", *SHEET, "r1", "c1", "r2", "c2")


def dependents(q: DataFrame, stored: DataFrame, max_levels: int = 1000, chains: bool = True) -> DataFrame:
    """All cells that depend on the queried ranges, directly or not, as disjoint rectangles: qid, file, sheet, r1, c1, r2, c2.

    Breadth first: each level maps the cells reached last through the edges, keeps what was not reached before, and writes it to the shared folder. Runs that
    depend on themselves cell by cell (running totals) are crossed in one level unless ``chains`` is false. On a cycle the queried cells are reached too.
    """
    return _closure(q, stored, "p", max_levels, chains)


def precedents(q: DataFrame, stored: DataFrame, max_levels: int = 1000, chains: bool = True) -> DataFrame:
    """All cells on which the queried ranges depend, directly or not, as ``dependents``."""
    return _closure(q, stored, "d", max_levels, chains)


def cells_of(rects: DataFrame, tall: bool = False) -> DataFrame:
    """Rectangles expanded to cells: qid, file, sheet, row, col. ``tall`` says that they are few and may be long: their parts are dealt over all cores."""
    if tall:
        parts = rects.withColumn("r1", F.explode(F.expr(f"sequence(r1, r2, {PIECE})"))).withColumn("r2", F.expr(f"least(r2, r1 + {PIECE - 1})"))
        rects = parts.repartition(lanes(rects.sparkSession))
    rows = rects.withColumn("row", F.explode(F.sequence("r1", "r2")))
    return rows.select("qid", *SHEET, "row", F.explode(F.sequence("c1", "c2")).alias("col")).distinct()


def coalesce_rects(rects: DataFrame, keys: list[str]) -> DataFrame:
    """Touching or overlapping rectangles of equal width merged downwards, then those of equal height across."""

    def merged(df: DataFrame, same: tuple[str, str], first: str, last: str) -> DataFrame:
        line = Window.partitionBy(*keys, *same).orderBy(first, last)
        before = F.max(last).over(line.rowsBetween(Window.unboundedPreceding, -1))
        df = df.withColumn("new", (before.isNull() | (F.col(first) > before + 1)).cast("int"))
        df = df.withColumn("island", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
        return df.groupBy(*keys, *same, "island").agg(F.min(first).alias(first), F.max(last).alias(last)).drop("island")

    return merged(merged(rects, ("c1", "c2"), "r1", "r2"), ("r1", "r2"), "c1", "c2").select(*keys, "r1", "c1", "r2", "c2")


def covering(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` (file, sheet, r1, c1, r2, c2) that lie inside one rectangle of ``b``."""
    a, b = a.withColumn("row_id", F.monotonically_increasing_id()), b.toDF(*[f"o_{c}" if c not in SHEET else c for c in b.columns])
    pairs = interval_join(a, b, ("r1", "c1", "r2", "c2"), ("o_r1", "o_c1", "o_r2", "o_c2"))
    inside: Column = (F.col("o_r1") <= F.col("r1")) & (F.col("o_r2") >= F.col("r2")) & (F.col("o_c1") <= F.col("c1")) & (F.col("o_c2") >= F.col("c2"))
    return pairs.where(inside).select(*SHEET, "r1", "c1", "r2", "c2").distinct()
