"""Tall sheets, long ranges and large query tables: what must hold at any size, on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from cellweft.model import TABLE_ROWS
from cellweft.operators import chains, compress, lookup
from cellweft.operators.extract import distinct_edges, extract
from cellweft.plans import queries
from cellweft.sources.grid import grid_cells

EDGE = ["dep_row", "dep_col", "r1", "c1", "r2", "c2"]
TEXTS = "file string, sheet string, row int, col int, text string"


def edges(spark, grid):
    return extract(grid_cells(spark, {"s": grid})).edges_raw


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def _rects(rng, n, height, width):
    return [(i, "f", "s", r, c, r + rng.randrange(height), c + rng.randrange(width)) for i, r, c in ((i, rng.randrange(60), rng.randrange(9)) for i in range(n))]


@pytest.mark.parametrize(("few", "small"), [(0, False), (30, True)])
def test_interval_join_is_brute_force(spark, monkeypatch, few, small):
    monkeypatch.setattr(lookup, "FEW_LONG", few)
    rng = random.Random(few)
    for (h, w), (h2, w2) in (((1, 1), (40, 4)), ((30, 4), (40, 5))):
        a, b = _rects(rng, 60, h, w), _rects(rng, 80, h2, w2)
        left = spark.createDataFrame(a, "i int, file string, sheet string, r1 int, c1 int, r2 int, c2 int")
        right = spark.createDataFrame(b, "j int, file string, sheet string, x1 int, y1 int, x2 int, y2 int")
        got = lookup.interval_join(left, right, ("r1", "c1", "r2", "c2"), ("x1", "y1", "x2", "y2"), small)
        assert rows(got, "i", "j") == sorted((p[0], q[0]) for p in a for q in b if p[3] <= q[5] and q[3] <= p[5] and p[4] <= q[6] and q[4] <= p[6])


def test_large_query_tables_are_not_broadcast_and_columns_are_in_the_key(spark, monkeypatch):
    monkeypatch.setattr(lookup, "FEW_LONG", 0)
    rng = random.Random(1)
    left = spark.createDataFrame(_rects(rng, 50, 1, 1), "i int, file string, sheet string, r1 int, c1 int, r2 int, c2 int")
    right = spark.createDataFrame(_rects(rng, 50, 9, 1), "j int, file string, sheet string, x1 int, y1 int, x2 int, y2 int")
    plan = lookup.interval_join(left, right, ("r1", "c1", "r2", "c2"), ("x1", "y1", "x2", "y2"))._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan
    assert all("col_key" in line for line in plan.splitlines() if "SortMergeJoin" in line)


def test_sheets_of_tables_are_taller_than_workbooks(spark, tmp_path):
    orders = spark.createDataFrame([(0, 1.0, 7), (1_100_000, 2.0, 14), (3_000_000, 2.0, 1)], "o_orderkey long, o_totalprice double, o_custkey long")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    found = rows(queries.edges_raw(spark, str(tmp_path)).where("dep_col = 1"), *EDGE)
    assert found == [(r, 1, r, 0, r, 0) for r in (0, 1_100_000, 3_000_000)]
    assert sorted(r.num_refs for r in queries.sheet_cells(spark, str(tmp_path)).where("col = 1").collect()) == [1, 1, 1]
    texts = spark.createDataFrame([("f", "s", 0, 1, "=A2000000")], TEXTS)
    assert extract(texts).edges_raw.count() == 0 and extract(texts, TABLE_ROWS).edges_raw.count() == 1  # a workbook's limit stands


def test_chains_and_runs_across_beyond_two_million_rows(spark):
    top = 2_097_152 + 5
    texts = spark.createDataFrame([("f", "s", top + k, 0, f"=A{top + k}") for k in range(1, 5)] + [("f", "s", top + 9, c, f"={'ABCD'[c - 1]}{top + 1}") for c in range(1, 5)], TEXTS)
    raw = extract(texts, TABLE_ROWS).edges_raw
    assert rows(chains.longest_chains(raw), "row", "col", "length", "cyclic") == [(top, 0, 4, False)]
    assert rows(chains.topological_order(raw).where("col = 0"), "row", "length") == [(top + k, k) for k in range(5)]
    assert rows(compress.expand(compress.compress(raw)), *EDGE) == rows(raw, *EDGE)
    assert rows(compress.compress(raw), "pattern") == [("RR",), ("RR",)]


@pytest.mark.parametrize("options", [compress.Options(gap=True), compress.Options(type_sensitive=True), compress.Options(in_row=True)])
def test_stretches_of_a_column_do_not_change_stored_edges(spark, monkeypatch, options):
    rng, pick, cols = random.Random(5), ["", "=A{r}*2", "=SUM(A$1:A{r})", "=SUM(A{r}:A$40)", "=A{r}+A$1", "=B{p}+A{r}", "=D{p}"], []
    for _ in range(4):
        col = []
        while len(col) < 30:
            col += [rng.choice(pick)] * rng.choice([1, 2, 9, 14])
        cols.append(col)
    raw = edges(spark, [[cols[c][r].format(r=r + 1, p=max(r, 1)) for c in range(4)] for r in range(30)])
    monkeypatch.setattr(compress, "BLOCK_ROWS", 4)
    names = ["p_r1", "p_c1", "p_r2", "p_c2", "d_r1", "d_c1", "d_r2", "d_c2", "pattern", "edge_type"]
    whole = rows(compress.compress(raw, options), *names)
    monkeypatch.setattr(compress, "STRETCH", 4)
    assert rows(compress.compress(raw, options), *names) == whole


@pytest.mark.parametrize("cap", [3, None])
def test_cell_edges_are_counted_from_intervals(spark, cap):
    raw = edges(spark, [["1", "2", "=SUM(A1:A9)+SUM(A3:B5)+A7+A11"], ["3", "4", "=A1+SUM(A1:B3)"], ["5", "", "=SUM(A4:A5)+SUM(A6:A7)+A9"]])
    cells = chains.cell_edges(raw, cap)
    assert cells.count() == cells.distinct().count()
    wanted = rows(cells.groupBy("dep_col").agg(F.count("*").alias("edges"), F.sum(F.col("prec_row").cast("long")).alias("mark")), "dep_col", "edges", "mark")
    by_hand = set()
    for dr, dc, r1, c1, r2, c2 in rows(raw, *EDGE):
        last = r2 if cap is None else min(r2, r1 - (-cap // (c2 - c1 + 1)) - 1)
        by_hand |= {(dr, dc, r, c) for r in range(r1, last + 1) for c in range(c1, c2 + 1)}
    assert wanted == [(2, len(by_hand), sum(x[2] for x in by_hand))] == rows(chains.cell_edge_counts(raw, cap), "dep_col", "edges", "mark")


def test_long_ranges_are_not_listed_to_be_counted(spark):
    """Four thousand million edges."""
    raw = extract(spark.range(4000).selectExpr("'f' AS file", "'s' AS sheet", "cast(id AS int) AS row", "1 AS col", "'=SUM(A1:A1000000)' AS text")).edges_raw
    assert rows(chains.cell_edge_counts(raw, None), "dep_col", "edges", "mark") == [(1, 4 * 10**9, 4000 * 999_999 * 500_000)]


def test_topological_order_has_all_cells_of_a_range(spark):
    order = {(r.row, r.col): (r.rank, r.length) for r in chains.topological_order(edges(spark, [["=SUM(B1:B250)", ""]] + [["", ""]] * 198 + [["", "=B1"]])).collect()}
    assert len(order) == 251 and order[199, 1][1] == 1
    assert order[0, 0] == (250, 2)


def test_edges_are_made_distinct_in_their_formula_without_a_shuffle(spark):
    texts = spark.createDataFrame([("f", "s", r, c, t) for r in range(3) for c, t in enumerate(["=A1+A1*B2", "=SUM(A1:A3)+A2+SUM(A1:A3)/A2", "=A9", "5", "=NOSUCH(A1)+A1"])], TEXTS)
    found = extract(texts)
    names = [*EDGE, "edge_type", "abs_r1"]
    assert rows(found.edges, *names) == rows(distinct_edges(found.edges_raw), *names) and found.edges.count() == 15 < found.edges_raw.count()
    assert "Exchange" not in found.edges._jdf.queryExecution().executedPlan().toString()


def test_edges_are_shuffled_once_to_be_compressed(spark):
    raw = edges(spark, [[f"=C{r}*2", f"=SUM(C$1:C{r})", "1"] for r in range(1, 40)])
    made = compress.compress(raw)
    assert rows(made, "d_c1", "pattern") == [(0, "RR"), (1, "FR")]
    assert "Arrow" not in made._jdf.queryExecution().executedPlan().toString()  # pieces are written, and only put together


def test_long_runs_and_rectangles_are_listed_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(compress, "PIECE", 7)
    monkeypatch.setattr(lookup, "PIECE", 7)
    raw = edges(spark, [[f"=D{r}*2", f"=SUM(D$1:D{r})", f"=D{r}" if r % 3 == 0 else "", "1"] for r in range(1, 60)])
    made = compress.expand(compress.compress(raw, compress.Options(gap=True)))
    assert rows(made, *EDGE) == rows(raw, *EDGE)
    assert made.select(F.spark_partition_id()).distinct().count() > 2
    rects = lookup.queries(spark, [(1, "f", "s", 3, 0, 50, 1), (1, "f", "s", 9, 1, 9, 2), (2, "f", "s", 0, 0, 6, 0)])
    assert rows(lookup.cells_of(rects, tall=True), "qid", "row", "col") == rows(lookup.cells_of(rects), "qid", "row", "col")
