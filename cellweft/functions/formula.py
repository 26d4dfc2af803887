"""Formula text to references: tokens, reverse Polish order, and the operator that uses each reference.

Formulas that are filled down or across have one shape: the text with its references taken out. A shape is parsed once per Python worker and its
plan (the order in which references leave the operand stack, and their edge types) is kept; a formula of a known
shape costs one pass of a regular expression.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from cellweft.model import MAX_COLS, MAX_ROWS

# Built-in worksheet functions by whether their number of arguments is fixed or variable.
FIXED_ARITY = frozenset("""
ABS ACOS ACOSH ASC ASIN ASINH ATAN ATAN2 ATANH BAHTTEXT BINOMDIST CEILING CHAR CHIDIST CHIINV CHITEST CLEAN CODE COLUMNS COMBIN CONFIDENCE CORREL
COS COSH COUNTBLANK COUNTIF COVAR CRITBINOM DATE DATEDIF DATESTRING DATEVALUE DAVERAGE DAY DBCS DCOUNT DCOUNTA DEGREES DGET DMAX DMIN DPRODUCT DSTDEV
DSTDEVP DSUM DVAR DVARP ERROR.TYPE EVEN EXACT EXP EXPONDIST FACT FALSE FDIST FINV FISHER FISHERINV FLOOR FORECAST FREQUENCY FTEST GAMMADIST GAMMAINV GAMMALN
HOUR HYPGEOMDIST INT INTERCEPT ISBLANK ISERR ISERROR ISLOGICAL ISNA ISNONTEXT ISNUMBER ISPMT ISREF ISTEXT LARGE LEN LENB LN LOG10 LOGINV LOGNORMDIST LOWER
MDETERM MID MIDB MINUTE MINVERSE MIRR MMULT MOD MONTH N NA NEGBINOMDIST NORMDIST NORMINV NORMSDIST NORMSINV NOT NOW ODD PEARSON PERCENTILE PERMUT PHONETIC PI
POISSON POWER PROPER QUARTILE RADIANS RAND REPLACE REPLACEB REPT ROUND ROUNDDOWN ROUNDUP ROWS RSQ SECOND SIGN SIN SINH SLN SLOPE SMALL SQRT STANDARDIZE STEYX
SUMX2MY2 SUMX2PY2 SUMXMY2 SYD T TAN TANH TDIST TEXT TIME TIMEVALUE TINV TODAY TRANSPOSE TRIM TRIMMEAN TRUE TTEST TYPE UPPER VALUE WEIBULL YEAR
""".split())
VARIABLE_ARITY = frozenset("""
ADDRESS AND AREAS AVEDEV AVERAGE AVERAGEA BETADIST BETAINV CELL CHOOSE COLUMN CONCATENATE COUNT COUNTA DAYS360 DB DDB DEVSQ DOLLAR FIND FINDB FIXED FV GEOMEAN
GETPIVOTDATA GROWTH HARMEAN HLOOKUP HYPERLINK IF INDEX INDIRECT INFO IPMT IRR KURT LEFT LEFTB LINEST LOG LOGEST LOOKUP MATCH MAX MAXA MEDIAN MIN MINA MODE NPER NPV
NUMBERSTRING OFFSET OR PERCENTRANK PMT PPMT PROB PRODUCT PV RANK RATE RIGHT RIGHTB ROMAN ROW RTD SEARCH SEARCHB SKEW STDEV STDEVA STDEVP STDEVPA SUBSTITUTE SUBTOTAL SUM
SUMIF SUMPRODUCT SUMSQ TREND TRUNC USDOLLAR VAR VARA VARP VARPA VDB VLOOKUP WEEKDAY ZTEST
""".split()) - {"AREAS"}

# Edge types of binary operators; all others are OTHER.
BINARY = {"+": "ADD", "-": "SUBTRACT", "*": "MULTIPLY", "/": "DIVIDE", "^": "POWER", "=": "COMPARE", "<>": "COMPARE", "<": "COMPARE", ">": "COMPARE", "<=": "COMPARE", ">=": "COMPARE"}


class FormulaError(ValueError):
    """The formula is malformed, or uses what dependencies are not tracked for."""


class Ref(NamedTuple):
    """A 0-based inclusive rectangle, with a flag for each absolute corner coordinate, and the edge type of its use."""

    r1: int
    c1: int
    r2: int
    c2: int
    abs_r1: bool
    abs_c1: bool
    abs_r2: bool
    abs_c2: bool
    edge_type: str = "OTHER"


_CELL = r"\$?[A-Za-z]{1,3}\$?[0-9]{1,10}"
_END = r"(?![A-Za-z0-9_.(!\\])"
_TOKEN = re.compile(
    rf"""(?P<space>\s+)
    |(?P<string>"(?:[^"]|"")*")
    |(?P<sheet>(?:'(?:[^']|'')+'|[A-Za-z0-9_.\[\]]+(?::[A-Za-z0-9_.]+)?)!)
    |(?P<error>\#(?:NULL!|DIV/0!|VALUE!|REF!|NAME\?|NUM!|N/A))
    |(?P<ref>{_CELL}\s*:\s*{_CELL}{_END}|{_CELL}{_END}|\$?[A-Za-z]{{1,3}}:\$?[A-Za-z]{{1,3}}{_END}|\$?[0-9]{{1,10}}:\$?[0-9]{{1,10}}{_END})
    |(?P<number>(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[Ee][-+]?[0-9]+)?)
    |(?P<func>[A-Za-z_\\][A-Za-z0-9_.\\]*\s*\()
    |(?P<table>[A-Za-z_\\][A-Za-z0-9_.\\]*\[)
    |(?P<name>[A-Za-z_\\][A-Za-z0-9_.\\?]*)
    |(?P<op><=|>=|<>|[-+*/^&=<>%(),;:{{}}])
    |(?P<bad>.)""",
    re.X | re.S,
)
_PART = re.compile(r"(\$?)([A-Za-z]*)(\$?)([0-9]*)")


def column_index(letters: str) -> int:
    """0-based index of a column label."""
    n = 0
    for x in letters.upper():
        n = 26 * n + ord(x) - 64
    return n - 1


def column_label(index: int) -> str:
    """Label of a 0-based column index, right beyond 702 too."""
    out, n = "", index + 1
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def parse_ref(text: str, max_rows: int = MAX_ROWS) -> Ref | None:
    """The rectangle that a reference names; None if it lies outside a sheet of ``max_rows`` rows."""
    first, _, last = (x.strip() for x in text.partition(":"))
    corners = []
    for part, far in ((first, False), (last or first, True)):
        d1, letters, d2, digits = _PART.fullmatch(part).groups()
        if letters and digits:
            row, col, ar, ac = int(digits) - 1, column_index(letters), bool(d2), bool(d1)
        elif letters:
            row, col, ar, ac = (max_rows - 1 if far else 0), column_index(letters), False, bool(d1 or d2)
        else:
            row, col, ar, ac = int(digits) - 1, (MAX_COLS - 1 if far else 0), bool(d1 or d2), False
        if not (0 <= row < max_rows and 0 <= col < MAX_COLS):
            return None
        corners.append((row, col, ar, ac))
    (ra, ca, ara, aca), (rb, cb, arb, acb) = corners
    if ra > rb:
        ra, rb, ara, arb = rb, ra, arb, ara
    if ca > cb:
        ca, cb, aca, acb = cb, ca, acb, aca
    return Ref(ra, ca, rb, cb, ara, aca, arb, acb)


class _Parser:
    """Recursive descent over a shape; emits operands (slot numbers) and operations (number of operands, edge type) in reverse Polish order."""

    def __init__(self, shape: tuple[str, ...]) -> None:
        self.shape, self.at, self.slot, self.out = shape, 0, 0, []

    def look(self) -> str:
        at = self.at
        while at < len(self.shape) and self.shape[at] == " ":
            at += 1
        return self.shape[at] if at < len(self.shape) else ""

    def take(self, want: str | None = None) -> str:
        while self.at < len(self.shape) and self.shape[self.at] == " ":
            self.at += 1
        if self.at >= len(self.shape) or (want and self.shape[self.at] != want):
            raise FormulaError(f"expected {want or 'an operand'}")
        self.at += 1
        return self.shape[self.at - 1]

    def parse(self) -> list:
        self.union()
        if self.look():
            raise FormulaError(f"unexpected {self.look()}")
        return self.out

    def union(self) -> None:
        self.level(0)
        while self.look() == ",":
            self.take()
            self.level(0)
            self.out.append((2, "SETOPERATION"))

    LEVELS = [("=", "<>", "<", ">", "<=", ">="), ("&",), ("+", "-"), ("*", "/"), ("^",)]

    def level(self, k: int) -> None:
        if k == len(self.LEVELS):
            return self.percent()
        self.level(k + 1)
        while (op := self.look()) in self.LEVELS[k]:
            self.take()
            self.level(k + 1)
            self.out.append((2, BINARY.get(op, "OTHER")))

    def percent(self) -> None:
        if self.look() in ("+", "-"):
            self.take()
            literal = self.look() == "0"
            self.level(4)
            if not literal or self.shape[self.at - 1] != "0":
                self.out.append((1, "OTHER"))
            return
        self.intersection()
        while self.look() == "%":
            self.take()
            self.out.append((1, "OTHER"))

    def intersection(self) -> None:
        self.range()
        while self.at < len(self.shape) and self.shape[self.at] == " " and (self.look() == "R" or self.look().endswith("(") and self.look() != "("):
            self.range()
            self.out.append((2, "SETOPERATION"))

    def range(self) -> None:
        self.factor()
        while self.look() == ":":
            self.take()
            self.factor()
            self.out.append((2, "OTHER"))

    def factor(self) -> None:
        token = self.take()
        if token == "R":
            self.out.append(self.slot)
            self.slot += 1
        elif token == "(":
            self.union()
            self.take(")")
        elif token == "{":
            while self.take() != "}":
                pass
        elif token.endswith("("):
            self.call(token[:-1])
        elif token not in ("0", "S", "E"):
            raise FormulaError(f"unexpected {token}")

    def call(self, name: str) -> None:
        count, after_condition = 0, name == "IF"
        if self.look() == ")":
            self.take()
        else:
            while True:
                if self.look() not in (",", ")"):
                    self.level(0)
                count += 1
                if after_condition and count <= 3:  # a jump follows the condition and each branch
                    self.out.append((1, "FUNCTION"))
                if self.take() == ")":
                    break
                if self.shape[self.at - 1] != ",":
                    raise FormulaError("expected , or )")
        if name == "SUM" and count == 1:
            self.out.append((1, "FUNCTION"))
        elif name in VARIABLE_ARITY:
            self.out.append((count, "FUNCTION"))
        else:
            self.out.append((count, "OTHER"))


@lru_cache(maxsize=65_536)
def _plan(shape: tuple[str, ...]) -> tuple[tuple[int, str], ...]:
    """(slot, edge type) in the order in which a formula's precedents are listed.

    References are pushed on a stack. An operation pops as many as it has operands, though results and constants are never pushed,
    so an operation with a constant operand also takes the reference below; what is left at the end is OTHER, from the top.
    """
    stack: list[int] = []
    out: list[tuple[int, str]] = []
    for item in _Parser(shape).parse():
        if isinstance(item, int):
            stack.append(item)
        else:
            for _ in range(min(item[0], len(stack))):
                out.append((stack.pop(), item[1]))
    while stack:
        out.append((stack.pop(), "OTHER"))
    return tuple(out)


def parse_formula(text: str, max_rows: int = MAX_ROWS) -> list[Ref]:
    """The references of a formula (without its = sign), in the order in which precedents are listed, repeats included.

    Raises FormulaError for malformed text, and for operands that are not cells of the same sheet: other sheets, names, tables, #REF!, and functions that are not built in.
    A reference beyond ``max_rows`` rows is outside the sheet; the default is the limit of a workbook.
    """
    refs: list[Ref] = []
    return [refs[slot]._replace(edge_type=kind) for slot, kind in _plan(_shape(text, max_rows, refs))]


def _shape(text: str, max_rows: int = MAX_ROWS, refs: list[Ref] | None = None) -> tuple[str, ...]:
    """The formula with its references taken out; these are appended to ``refs``."""
    shape: list[str] = []
    for m in _TOKEN.finditer(text):
        kind, word = m.lastgroup, m[0]
        if kind == "ref":
            ref = parse_ref(word, max_rows)
            if ref is None:
                raise FormulaError(f"reference outside the sheet: {word}")
            if refs is not None:
                refs.append(ref)
            shape.append("R")
        elif kind == "space":
            shape.append(" ")
        elif kind == "number":
            shape.append("0")
        elif kind == "string":
            shape.append("S")
        elif kind == "op":
            shape.append("," if word == ";" and "{" not in shape else word)
        elif kind == "func":
            name = word[:-1].strip().upper().removeprefix("_XLFN.")
            if name not in VARIABLE_ARITY and name not in FIXED_ARITY:
                raise FormulaError(f"not a built-in function: {name}")
            shape.append(name + "(")
        elif kind == "error" and word != "#REF!":
            shape.append("E")
        elif kind == "name" and word.upper() in ("TRUE", "FALSE"):
            shape.append("S")
        else:
            raise FormulaError({"sheet": "reference to another sheet", "error": "reference error", "name": "name", "table": "table reference"}.get(kind, "unreadable") + f": {word}")
    return tuple(shape)


@lru_cache(maxsize=4_096)
def skeleton_plan(text: str) -> tuple[tuple, ...] | None:
    """How the references of all formulas with the skeleton ``text`` follow from their numbers; a skeleton is a formula with each run of digits made 1.

    For each precedent, in the order of ``parse_formula``: for both corners the run of digits that is the row, the column, and whether row and column are absolute; then the
    edge type. None if other numbers may be read otherwise (digits in names, references by whole rows or columns), or if there is an error. Runs of up to ten digits
    do not change how a text is cut into tokens.
    """
    try:
        found = parse_formula(text)
    except FormulaError:
        return None
    slots, seen = [], 0
    for m in _TOKEN.finditer(text):
        digits = m[0].count("1")
        if m.lastgroup == "ref":
            corners = []
            for part in m[0].split(":"):
                d1, letters, d2, row = _PART.fullmatch(part.strip()).groups()
                if not (letters and row):
                    return None
                corners.append((seen + len(corners), column_index(letters), bool(d2), bool(d1)))
            slots.append((*corners[0], *corners[-1]))
        elif digits and m.lastgroup not in ("number", "string"):
            return None
        seen += digits
    return tuple((*slots[slot], kind) for slot, kind in _plan(_shape(text))) if len(found) else ()


def shift_formula(text: str, rows: int, cols: int) -> str:
    """The formula as it reads when filled ``rows`` down and ``cols`` to the right: relative coordinates move."""

    def corner(part: str) -> str:
        d1, letters, d2, digits = _PART.fullmatch(part.strip()).groups()
        if letters:
            letters = letters if d1 else column_label((column_index(letters) + cols) % MAX_COLS)
        if digits:
            fixed = d2 if letters else d1
            digits = digits if fixed else str((int(digits) - 1 + rows) % MAX_ROWS + 1)
        return d1 + letters + d2 + digits

    return "".join(":".join(map(corner, m[0].split(":"))) if m.lastgroup == "ref" else m[0] for m in _TOKEN.finditer(text))
