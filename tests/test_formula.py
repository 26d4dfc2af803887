import random

import pyarrow as pa
import pytest

from cellweft.functions.formula import FormulaError, column_index, column_label, parse_formula, shift_formula
from cellweft.operators import extract


def refs(text):
    return [(column_label(r.c1) + str(r.r1 + 1), column_label(r.c2) + str(r.r2 + 1), r.edge_type) for r in parse_formula(text)]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("A1+B1*2", [("B1", "B1", "MULTIPLY"), ("A1", "A1", "MULTIPLY")]),
        ("A1+B1*C1", [("C1", "C1", "MULTIPLY"), ("B1", "B1", "MULTIPLY"), ("A1", "A1", "ADD")]),
        ("SUM(A$1:A5)", [("A1", "A5", "FUNCTION")]),
        ("IF(A1>B1,C1,D1)", [("B1", "B1", "COMPARE"), ("A1", "A1", "COMPARE"), ("C1", "C1", "FUNCTION"), ("D1", "D1", "FUNCTION")]),
        ("ABS(A1)", [("A1", "A1", "OTHER")]),
        ("SUM((A1,B1))", [("B1", "B1", "SETOPERATION"), ("A1", "A1", "SETOPERATION")]),
        ("A1:B2 B1:C3", [("B1", "C3", "SETOPERATION"), ("A1", "B2", "SETOPERATION")]),
        ('"A1"&B1', [("B1", "B1", "OTHER")]),
        ("{1,2;3,4}+A1", [("A1", "A1", "ADD")]),
        ("1+2", []),
        ("LOG10(A1)", [("A1", "A1", "OTHER")]),
        ("B2:A1", [("A1", "B2", "OTHER")]),
    ],
)
def test_order_and_edge_types(text, wanted):
    assert refs(text) == wanted


@pytest.mark.parametrize("text", ["Other!A1", "'my sheet'!A1", "rate+1", "Table1[x]", "NOSUCH(A1)", "#REF!+A1", "A1+", "(A1", "XFE1", "", "A1048577"])
def test_rejected(text):
    with pytest.raises(FormulaError):
        parse_formula(text)


def test_dollars_and_whole_columns():
    r = parse_formula("$A1:B$2")[0]
    assert (r.abs_r1, r.abs_c1, r.abs_r2, r.abs_c2) == (False, True, True, False)
    assert parse_formula("C:C")[0][:4] == (0, 2, 1_048_575, 2)
    assert parse_formula("2:3")[0][:4] == (1, 0, 2, 16_383)


def test_labels_round_trip():
    for i, label in ((0, "A"), (25, "Z"), (26, "AA"), (701, "ZZ"), (702, "AAA"), (16_383, "XFD")):
        assert column_label(i) == label and column_index(label) == i


def test_shared_formulas_shift():
    assert shift_formula("SUM(A$1:A5)+$B2+LOG10(3)", 2, 1) == "SUM(B$1:B7)+$B4+LOG10(3)"


FILLED = ["A{}*2", "SUM(A$1:A{})", "SUM($C{}:b${} )", "A{}/$A$1", "LOG10(A{})+LOG{}(B2)", "DAYS{}(A1)", "#DIV/{}!+A1", "IF(A{}>{},B{},\"x{}\")", "A:A+B{}", "{}:{}", "X!A{}", "Sheet{}!A1", "{}E{}", "A{}B",
          "A{}:B{}:C{}", "A{} B{}", "nm{}+1", "ABCD{}", "XFE{}", "XFD{}", "A{}(", "", "{}", "SUM(D{}:A{},C{})", "A{}..5", "\u00c9{}+A{}", "A{}\u0663", "{}A{}", "T[{}]"]


def test_filled_formulas_are_parsed_together_with_the_same_results():
    """Numbers at limits, of many digits, and with zeros in front; skeletons that occur often, seldom, and with others between."""
    rng, odd = random.Random(3), [0, 1, 9, 10, 99, 100, 1_048_576, 1_048_577, 999_999_999, 1_234_567_890, 12_345_678_901, "007"]
    for _ in range(20):
        texts = [t.format(*[rng.choice(odd) if rng.random() < 0.3 else rng.randrange(1, 5000) for _ in range(4)]) for t in rng.sample(FILLED, 10) for _ in range(rng.choice([1, 3, 9, 20]))] + [None] * 3
        rng.shuffle(texts)
        for got, f in zip(extract._parsed(pa.array(["x", *texts], pa.string())[1:]).to_pylist(), texts):
            try:
                wanted = {"refs": [r._asdict() for r in parse_formula(f)] if f is not None else [], "error": None}
            except FormulaError as e:
                wanted = {"refs": [], "error": str(e)}
            assert got == wanted, f


def test_filled_formulas_are_not_parsed_one_by_one(monkeypatch):
    monkeypatch.setattr(extract, "parse_formula", None)
    got = extract._parsed(pa.array([f"SUM(A{r}:A$9)" for r in range(5, 15)], pa.string())).to_pylist()
    assert [(x["refs"][0]["r1"], x["refs"][0]["r2"], x["refs"][0]["abs_r1"]) for x in got] == [(min(r, 9) - 1, max(r, 9) - 1, r > 9) for r in range(5, 15)]
