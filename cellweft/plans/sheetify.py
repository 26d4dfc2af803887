"""Template sheets over tables: formula text made from rows by a fixed rule, for queries that other engines can check.

Row r (from 1) of the sheet has: A a value; B ``=A{r}*2``; C ``=SUM(A$1:A{r})``; D ``=SUM(A{r}:A$N)``; E ``=A{r}/$A$1``; F ``=F{r-1}+A{r}`` (a value in row 1); G ``=A{r}`` in every
third row; H, where the table's mark is a multiple of 7, ``=SUM(A{x}:B{y})`` with x = mark * 31 mod N + 1 and y = min(N, x + mark mod 5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweft.runtime import spread, table

#: Tables with keys 0 to n - 1: the key, the value, and the mark.
SHEETS = {"orders": ("o_orderkey", "o_totalprice", "o_custkey"), "supplier": ("s_suppkey", "s_acctbal", "s_nationkey"), "customer": ("c_custkey", "c_acctbal", "c_nationkey")}


def sheet_texts(spark: SparkSession, sf_dir: str, name: str = "orders", columns: str = "ABCDEFGH") -> DataFrame:
    """Cell texts of the template over a table; the file is ``tables`` and the sheet the table's name."""
    key, value, mark = SHEETS[name]
    rows = table(spark, sf_dir, name)
    n = rows.count()
    low = rows.agg(F.min(key)).first()[0] or 0
    rows = rows.select((F.col(key) - low + 1).cast("int").alias("r"), F.col(value).cast("string").alias("v"), F.col(mark).cast("long").alias("m"))
    rows = spread(rows)
    x, r = F.col("m") * 31 % n + 1, F.col("r").cast("string")
    text = {
        "A": F.col("v"),
        "B": F.concat(F.lit("=A"), r, F.lit("*2")),
        "C": F.concat(F.lit("=SUM(A$1:A"), r, F.lit(")")),
        "D": F.concat(F.lit("=SUM(A"), r, F.lit(f":A${n})")),
        "E": F.concat(F.lit("=A"), r, F.lit("/$A$1")),
        "F": F.when(F.col("r") == 1, F.col("v")).otherwise(F.concat(F.lit("=F"), (F.col("r") - 1).cast("string"), F.lit("+A"), r)),
        "G": F.when(F.col("r") % 3 == 1, F.concat(F.lit("=A"), r)),
        "H": F.when(F.col("m") % 7 == 0, F.concat(F.lit("=SUM(A"), x.cast("string"), F.lit(":B"), F.least(F.lit(n), x + F.col("m") % 5).cast("string"), F.lit(")"))),
    }
    cells = F.array(*[F.struct(F.lit(ord(c) - 65).alias("col"), t.alias("text")) for c, t in text.items() if c in columns])
    rows = rows.select(F.lit("tables").alias("file"), F.lit(name).alias("sheet"), (F.col("r") - 1).alias("row"), F.explode(cells).alias("c"))
    return rows.select("file", "sheet", "row", "c.col", "c.text").where("text is not null")


def edges_sql(name: str = "orders", columns: str = "ABCDEFGH") -> str:
    """SQL for the distinct edges (dep_row, dep_col, r1, c1, r2, c2, edge_type) of the template."""
    key, _, mark = SHEETS[name]
    base = f"(SELECT CAST({key} - (SELECT min({key}) FROM {name}) AS INT) AS r, CAST({mark} AS BIGINT) AS m, (SELECT count(*) FROM {name}) AS n FROM {name})"
    part = {
        "B": f"SELECT r, 1, r, 0, r, 0, 'MULTIPLY' FROM {base}",
        "C": f"SELECT r, 2, 0, 0, r, 0, 'FUNCTION' FROM {base}",
        "D": f"SELECT r, 3, r, 0, n - 1, 0, 'FUNCTION' FROM {base}",
        "E": f"SELECT r, 4, r, 0, r, 0, 'DIVIDE' FROM {base} UNION SELECT r, 4, 0, 0, 0, 0, 'DIVIDE' FROM {base}",
        "F": f"SELECT r, 5, r - 1, 5, r - 1, 5, 'ADD' FROM {base} WHERE r > 0 UNION ALL SELECT r, 5, r, 0, r, 0, 'ADD' FROM {base} WHERE r > 0",
        "G": f"SELECT r, 6, r, 0, r, 0, 'OTHER' FROM {base} WHERE r % 3 = 0",
        "H": f"SELECT r, 7, m * 31 % n, 0, least(n, m * 31 % n + 1 + m % 5) - 1, 1, 'FUNCTION' FROM {base} WHERE m % 7 = 0",
    }
    union = " UNION ALL ".join(f"({part[c]})" for c in columns if c in part)
    ints = ", ".join(f"CAST({k} AS INT) AS {k}" for k in ("dep_row", "dep_col", "r1", "c1", "r2", "c2"))
    return f"SELECT {ints}, edge_type FROM ({union}) t(dep_row, dep_col, r1, c1, r2, c2, edge_type)"
