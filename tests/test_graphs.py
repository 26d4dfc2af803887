"""Graphs of small sheets against plain Python, and the documented cases one by one."""

import random

import pytest

from cellweft.operators import chains, edit, lookup
from cellweft.operators.compress import Options, compress, expand
from cellweft.operators.extract import extract, referenced_blanks
from cellweft.plans.analyzer import WorkbookAnalyzer
from cellweft.sources.grid import grid_cells
from cellweft.sources.workbook import read_workbooks, write_xlsx

EDGE = ["dep_row", "dep_col", "r1", "c1", "r2", "c2"]
RUN = {
    "rr": [["1", f"=A{r}*2"] for r in range(1, 6)],
    "fr": [["1", f"=SUM(A$1:A{r})"] for r in range(1, 6)],
    "rf": [["1", f"=SUM(A{r}:A$5)"] for r in range(1, 6)],
    "ff": [["1", "=SUM(A$1:A$3)"] for _ in range(5)],
    "chain": [["1"]] + [[f"=A{r - 1}+1"] for r in range(2, 6)],
    "gap": [["1", f"=A{r}" if r % 2 else ""] for r in range(1, 6)],
    "row": [["1"] * 5, [f"={c}1*2" for c in "ABCDE"]],
}


def edges(spark, grid):
    return extract(grid_cells(spark, {"s": grid})).edges_raw


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize(
    ("name", "pattern", "prec", "dep"),
    [("rr", "RR", (0, 0, 4, 0), (0, 1, 4, 1)), ("fr", "FR", (0, 0, 4, 0), (0, 1, 4, 1)), ("rf", "RF", (0, 0, 4, 0), (0, 1, 4, 1)), ("ff", "FF", (0, 0, 2, 0), (0, 1, 4, 1)), ("chain", "RR", (0, 0, 3, 0), (1, 0, 4, 0)), ("gap", "RRGapOne", (0, 0, 4, 0), (0, 1, 4, 1)), ("row", "RR", (0, 0, 0, 4), (1, 0, 1, 4))],
)
def test_one_run_is_one_edge(spark, name, pattern, prec, dep):
    stored = compress(edges(spark, RUN[name]), Options(gap=True))
    assert rows(stored, "p_r1", "p_c1", "p_r2", "p_c2", "d_r1", "d_c1", "d_r2", "d_c2", "pattern") == [(*prec, *dep, pattern)]


def test_gap_runs_are_looked_up_exactly(spark):
    stored = compress(edges(spark, RUN["gap"]), Options(gap=True))
    q = lookup.queries(spark, [(r, "grid", "s", r, 0, r, 0) for r in range(5)])
    assert rows(lookup.cells_of(lookup.dependents(q, stored)), "qid", "row", "col") == [(0, 0, 1), (2, 2, 1), (4, 4, 1)]
    cut = edit.clear_cells(stored, spark.createDataFrame([("grid", "s", 2, 1)], "file string, sheet string, row int, col int"))
    assert rows(expand(cut), "dep_row") == [(0,), (4,)]


def test_contained_edges_are_not_lost(spark):
    grid = [["1", "", "=A1"], ["2", "", "=A2"], ["3", "", "=A1+A3"]]
    q = lookup.queries(spark, [(0, "grid", "s", 0, 0, 0, 0)])
    assert rows(lookup.cells_of(lookup.dependents(q, compress(edges(spark, grid)))), "row", "col") == [(0, 2), (2, 2)]


def test_dollar_decides_ties_and_types_split(spark):
    grid = [["1", "2", "", "=A1*B1"], ["3", "4", "", "=A2+B2"]]
    assert compress(edges(spark, grid)).count() == 2
    assert compress(edges(spark, grid), Options(type_sensitive=True)).count() == 4


def test_delete_splits_a_run(spark):
    stored = compress(edges(spark, RUN["fr"]))
    cut = edit.clear_cells(stored, spark.createDataFrame([("grid", "s", 2, 1)], "file string, sheet string, row int, col int"))
    assert rows(cut, "p_r1", "p_r2", "d_r1", "d_r2", "pattern") == [(0, 1, 0, 1, "FR"), (0, 4, 3, 4, "FR")]


def _random_grid(rng):
    pick = ["", "1", "=A{a}", "=SUM(A{a}:B{b})", "=A${a}+B{r}", "=A{r}", "=B{p}", "=SUM(A$1:A{r})"]
    return [[rng.choice(pick).format(a=rng.randint(1, 3), b=rng.randint(3, 6), r=r + 1, p=max(r, 1)) for _ in range(5)] for r in range(6)]


@pytest.mark.parametrize("seed", [1])
def test_random_sheets(spark, seed):
    raw = edges(spark, _random_grid(random.Random(seed)))
    wanted = sorted({tuple(r) for r in raw.select(*EDGE).collect()})
    for options in (Options(gap=True, dollar=False), Options(in_row=True), Options(type_sensitive=True)):
        assert rows(expand(compress(raw, options)), *EDGE) == wanted
    below: dict = {}
    above: dict = {}
    for dr, dc, r1, c1, r2, c2 in wanted:
        for cell in ((i, j) for i in range(r1, r2 + 1) for j in range(c1, c2 + 1)):
            below.setdefault(cell, set()).add((dr, dc))
            above.setdefault((dr, dc), set()).add(cell)

    def closure(near, start):
        seen, stack = set(), [start]
        while stack:
            for y in near.get(stack.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    stack.append(y)
        return seen

    q = lookup.queries(spark, [(i, "grid", "s", i % 6, i // 6, i % 6, i // 6) for i in range(12)])
    for stored in (compress(raw, Options(gap=True)),):
        for find, near in ((lookup.dependents, below), (lookup.precedents, above)):
            assert rows(lookup.cells_of(find(q, stored)), "qid", "row", "col") == sorted((i, *c) for i in range(12) for c in closure(near, (i % 6, i // 6)))


def test_chains_and_cycles(spark):
    chain = edges(spark, RUN["chain"])
    assert rows(chains.longest_chains(chain), "row", "col", "length", "cyclic") == [(0, 0, 4, False)]
    cycle = edges(spark, [["=B1", "=A1"], ["1", "=A2"]])
    assert rows(chains.longest_chains(cycle), "row", "col", "length", "cyclic") == [(1, 0, 1, True)]
    capped = edges(spark, [["=SUM(B1:B250)"]])
    assert chains.cell_edges(capped).count() == 100 and chains.cell_edges(capped, None).count() == 250


def test_referenced_blanks_are_not_capped(spark):
    found = extract(grid_cells(spark, {"s": [["=SUM(B1:B250)", "", "=SUM(B200:C260)"], ["", "1"]]}))
    wanted = sorted({(r, 1) for r in range(250)} | {(r, c) for r in range(199, 260) for c in (1, 2)})
    exists = {tuple(r) for r in found.cells.select("row", "col").collect()}
    assert rows(referenced_blanks(found.edges_raw, found.cells), "row", "col") == [x for x in wanted if x not in exists]
    assert referenced_blanks(found.edges_raw, found.cells, 100).count() < 200


def test_rejected_cells_and_blank_formulas(spark):
    found = extract(grid_cells(spark, {"a,b": [["=Other!A1", "=1+2", "x"]]}))
    assert rows(found.cells, "sheet", "col", "is_formula", "num_refs") == [("a-b", 0, False, None), ("a-b", 1, True, 0), ("a-b", 2, False, None)]
    assert found.edges_raw.count() == 0


def test_analyzer_over_workbook_files(spark, tmp_path):
    write_xlsx(str(tmp_path / "one.xlsx"), {"s": RUN["fr"], "t": RUN["chain"]})
    (tmp_path / "bad.xlsx").write_bytes(b"no workbook")
    read = read_workbooks(spark, str(tmp_path))
    assert read.where("error is not null").count() == 1
    a = WorkbookAnalyzer.from_files(spark, str(tmp_path))
    assert (a.num_sheets(), a.num_formulas(), a.num_edges(), a.num_comp_edges(), a.file_errors.count()) == (2, 9, 9, 2, 1)
    assert rows(a.dependents("s", (1, 0, 1, 0)), "r1", "c1", "r2", "c2") == [(1, 1, 4, 1)]
    assert a.dependents("nosuch", (0, 0, 0, 0)).count() == 0 and a.dependents("s", (-1, 0, 0, 0)).count() == 0
    assert rows(a.longest_chain(), "sheet", "length") == [("t", 4)]
    assert a.precedents_subgraph("t", (4, 0, 4, 0), direct=True).count() == 1


@pytest.mark.parametrize("damage", ["crc", "deflate", "cell", "kind"])
def test_damaged_workbooks_do_not_fail_others(spark, tmp_path, damage):
    import zipfile

    write_xlsx(str(tmp_path / "good.xlsx"), {"s": [["1", "=A1"]]})
    write_xlsx(str(tmp_path / "bad.xlsx"), {"s": [["1", "=A1", "x" * 500]]})
    data = bytearray((tmp_path / "bad.xlsx").read_bytes())
    if damage in ("crc", "deflate"):
        with zipfile.ZipFile(tmp_path / "bad.xlsx") as z:
            info = z.getinfo("xl/worksheets/sheet1.xml")
        body = info.header_offset + 30 + len(info.filename)
        if damage == "deflate":
            data[body : body + 4] = b"\xff" * 4
        else:
            at = data.index(b"PK\x01\x02", data.rindex(b"xl/worksheets/sheet1.xml") - 60) + 16
            data[at : at + 4] = b"\0" * 4
        (tmp_path / "bad.xlsx").write_bytes(data)
    else:
        source = zipfile.ZipFile(tmp_path / "bad.xlsx")
        parts = {n: source.read(n) for n in source.namelist()}
        parts["xl/worksheets/sheet1.xml"] = parts["xl/worksheets/sheet1.xml"].replace(*((b'r="A1"', b'r="?1"') if damage == "cell" else (b"<v>1</v>", b"<v>one</v>")))
        with zipfile.ZipFile(tmp_path / "bad.xlsx", "w") as z:
            for n, part in parts.items():
                z.writestr(n, part)
    found = read_workbooks(spark, str(tmp_path)).collect()
    assert sorted(r["text"] for r in found if r["error"] is None) == ["1.0", "=A1"]
    assert [r["file"].rpartition("/")[2] for r in found if r["error"] is not None] == ["bad.xlsx"]


def test_number_texts():
    from cellweft.sources.workbook import number_text

    given = {"1": "1.0", "0": "0.0", "-2.50": "-2.5", "1234567": "1234567.0", "10000000": "1.0E7", "0.001": "0.001", "0.0005": "5.0E-4", "1e300": "1.0E300", "123456789.5": "1.234567895E8"}
    assert {k: number_text(k) for k in given} == given


def test_added_edges_keep_the_flags_of_patterns(spark):
    first, more = edges(spark, RUN["ff"]), edges(spark, [["1", "", "=A1"]])
    again = edit.add_edges(compress(first), more)
    assert rows(again, "pattern", "d_r1", "d_r2", "d_c1") == [("FF", 0, 4, 1), ("NoComp", 0, 0, 2)]


def _brute_chains(raw):
    """(length, first cell) of the longest path to each cell, and the cells on or behind a cycle."""
    near = {}
    for dr, dc, r1, c1, r2, c2 in raw:
        near.setdefault((dr, dc), set()).update((i, j) for i in range(r1, r2 + 1) for j in range(c1, c2 + 1))
    known = {x: (0, x) for cells in near.values() for x in cells if x not in near}
    while True:
        ready = {x: max(((known[y][0] + 1, known[y][1]) for y in ys), key=lambda b: (b[0], (-b[1][0], -b[1][1]))) for x, ys in near.items() if x not in known and all(y in known for y in ys)}
        if not ready:
            return known, set(near) - set(known)
        known |= ready


@pytest.mark.parametrize("seed", [2, 3])
def test_chains_against_plain_python(spark, seed):
    raw = edges(spark, _random_grid(random.Random(seed)))
    known, cyclic = _brute_chains({tuple(r) for r in raw.select(*EDGE).collect()})
    order = chains.topological_order(raw, None).collect()
    assert {(r["row"], r["col"]): r["length"] for r in order if not r["cyclic"]} == {x: n for x, (n, _) in known.items()} and {(r["row"], r["col"]) for r in order if r["cyclic"]} == cyclic
    assert [x for _, x in sorted((r["rank"], (r["row"], r["col"])) for r in order if not r["cyclic"])] == sorted(known, key=lambda x: (known[x][0], x))
    best = max(n for n, _ in known.values())
    assert rows(chains.longest_chains(raw, None), "row", "col", "length", "cyclic") == [(*min(s for n, s in known.values() if n == best), best, bool(cyclic))]


def test_runs_over_folders(spark, tmp_path):
    from cellweft.plans import runs

    folder = tmp_path / "books"
    folder.mkdir()
    write_xlsx(str(folder / "one.xlsx"), {"a,b": RUN["fr"]})
    write_xlsx(str(folder / "two.xlsx"), {"t": RUN["chain"]})
    (folder / "bad.xlsx").write_bytes(b"PK")
    write_xlsx(str(tmp_path / "list.xlsx"), {"m": [["File name", "x", " max dep ref"], ["one.xlsx", "", "a,b:A2"], ["two.xlsx", "", "t:A1"], ["none.xlsx", "", "t:A1"]]})
    runs.statistics_run(spark, str(folder), str(tmp_path / "statistics"))
    found = spark.read.option("header", True).csv(str(tmp_path / "statistics"))
    assert found.columns[:7] == ["fileName", "numFormulae", "numVertices", "numEdges", "numCompVertices", "numCompEdges", "graphBuildTime"] and len(found.columns) == 7 + 26
    assert rows(found, "fileName", "numFormulae", "numEdges", "numCompEdges", "FR_Comp", "FR_NoComp", "RR_NoComp") == [("one.xlsx", "5", "5", "1", "1", "5", "0"), ("two.xlsx", "4", "4", "1", "0", "0", "4")]
    runs.lookup_run(spark, str(folder), str(tmp_path / "list.xlsx"), str(tmp_path / "lookups"))
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "lookups")), "fileName", "ref", "LookupSize") == [("one.xlsx", "a,b:r2c1", "1"), ("two.xlsx", "t:r1c1", "1")]
    a = WorkbookAnalyzer.from_grid(spark, {"s": RUN["fr"]})
    assert runs.deletion_run(a, "s", 1, 1, 3) > 0 and rows(expand(a.graph), "dep_row") == [(0,), (4,)]


def test_streamed_edits(spark, tmp_path):
    from cellweft.streaming.edits import EditedGraph

    graph = EditedGraph(compress(edges(spark, RUN["rr"])), str(tmp_path / "graphs"))
    texts = spark.createDataFrame([("grid", "s", 1, 1, "=A5"), ("grid", "s", 2, 1, "7")], "file string, sheet string, row int, col int, text string")
    graph.apply(texts, 0)
    graph.apply(texts, 0)
    assert rows(expand(graph.graph()), "dep_row", "r1") == [(0, 0), (1, 4), (3, 3), (4, 4)]
