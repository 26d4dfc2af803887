"""Workbook files (.xlsx) as a source: one file a task, read with the standard library only."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweft.functions.formula import column_index, shift_formula

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_AT = re.compile(r"([A-Za-z]+)([0-9]+)")

# Codes of error cells.
ERROR_CODES = {"#NULL!": "0", "#DIV/0!": "7", "#VALUE!": "15", "#REF!": "23", "#NAME?": "29", "#NUM!": "36", "#N/A": "42"}


class WorkbookError(ValueError):
    """The file is not a workbook that can be read."""


def number_text(text: str) -> str:
    """A number as the engine's value text: always with a fraction, in scientific form from ten million on and below a thousandth."""
    value = float(text)
    if value == 0 or 1e-3 <= abs(value) < 1e7:
        return repr(value) if "e" not in repr(value) else f"{value:.17f}".rstrip("0")
    mantissa, _, exponent = f"{value!r}".partition("e")
    if not exponent:
        digits = f"{value:e}"
        for precision in range(17):
            digits = f"{value:.{precision}e}"
            if float(digits) == value:
                break
        mantissa, _, exponent = digits.partition("e")
    return f"{mantissa if '.' in mantissa else mantissa + '.0'}E{int(exponent)}"


def _text(node: ElementTree.Element | None) -> str:
    """All text of a string item, without phonetic runs."""
    if node is None:
        return ""
    own = "".join(t.text or "" for t in node.findall(f"{_NS}t"))
    return own + "".join(t.text or "" for r in node.findall(f"{_NS}r") for t in r.findall(f"{_NS}t"))


def read_xlsx(data: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, col, text) of every cell; formulas have a leading =, shared ones are written out, and values are as texts."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        names = set(archive.namelist())
        book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise WorkbookError(f"not a workbook: {e}") from e
    strings: list[str] = []
    if "xl/sharedStrings.xml" in names:
        strings = [_text(si) for si in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")).findall(f"{_NS}si")]
    for sheet in book.iter(f"{_NS}sheet"):
        target = rels[sheet.get(_REL)]
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        if path not in names or "worksheets" not in path:
            continue
        masters: dict[str, tuple[int, int, str]] = {}
        row = -1
        with archive.open(path) as stream:
            for _, node in ElementTree.iterparse(stream):
                if node.tag != f"{_NS}row":
                    continue
                row = int(node.get("r")) - 1 if node.get("r") else row + 1
                col = -1
                for c in node.findall(f"{_NS}c"):
                    if c.get("r") and not (name := _AT.fullmatch(c.get("r"))):
                        raise WorkbookError(f"no cell name: {c.get('r')}")
                    col = column_index(name[1]) if c.get("r") else col + 1
                    text = _cell(c, strings, masters, row, col)
                    if text is not None:
                        yield sheet.get("name"), row, col, text
                node.clear()


def _cell(c: ElementTree.Element, strings: list[str], masters: dict[str, tuple[int, int, str]], row: int, col: int) -> str | None:
    f, v, kind = c.find(f"{_NS}f"), c.find(f"{_NS}v"), c.get("t", "n")
    if f is not None:
        text, shared = f.text or "", f.get("si") if f.get("t") == "shared" else None
        if shared is not None and text:
            masters[shared] = (row, col, text)
        elif shared is not None and shared in masters:
            r, k, master = masters[shared]
            text = shift_formula(master, row - r, col - k)
        if text:
            return "=" + text
    if kind == "inlineStr":
        return _text(c.find(f"{_NS}is"))
    if v is None or v.text is None:
        return ""
    if kind == "s":
        return strings[int(v.text)]
    if kind == "b":
        return "true" if v.text == "1" else "false"
    if kind == "e":
        return ERROR_CODES.get(v.text, v.text)
    return v.text if kind == "str" else number_text(v.text)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Cell texts of the workbooks that ``path`` (a file, folder or glob) names: file, sheet, row, col, text, error.

    A file that cannot be read gives one row with its reason in ``error`` and null elsewhere, and does not fail others. Files are spread over tasks; a task
    holds one file at a time.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    rows = [(file, *cell, None) for cell in read_xlsx(data.as_py())]
                except Exception as e:  # whatever is wrong with one file must not end the job
                    rows = [(file, None, None, None, None, f"{type(e).__name__}: {e}")]
                columns = list(zip(*rows)) or [()] * 6
                kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "sheet", "row", "col", "text", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.where(F.lower("path").endswith(".xlsx") | F.lower("path").endswith(".xls")).mapInArrow(read, "file string, sheet string, row int, col int, text string, error string")


def write_xlsx(path: str, sheets: dict[str, list[list[str]]]) -> None:
    """A small workbook for tests and exports: texts with a leading = are formulas, numbers are numbers, others are strings."""
    from xml.sax.saxutils import escape, quoteattr

    from cellweft.functions.formula import column_label

    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main = _NS[1:-1]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/></Types>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{_REL[1:-3]}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        for k, grid in enumerate(sheets.values(), 1):
            rows = []
            for r, line in enumerate(grid, 1):
                cells = []
                for c, text in enumerate(line):
                    at = f"{column_label(c)}{r}"
                    if text.startswith("="):
                        cells.append(f'<c r="{at}"><f>{escape(text[1:])}</f></c>')
                    elif re.fullmatch(r"-?[0-9]+(\.[0-9]+)?", text):
                        cells.append(f'<c r="{at}"><v>{text}</v></c>')
                    elif text:
                        cells.append(f'<c r="{at}" t="inlineStr"><is><t>{escape(text)}</t></is></c>')
                rows.append(f'<row r="{r}">{"".join(cells)}</row>')
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'{head}<worksheet xmlns="{main}"><sheetData>{"".join(rows)}</sheetData></worksheet>')
