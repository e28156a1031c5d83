"""Run a query next to its SQL twin and compare all values."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _cell(v: object) -> object:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19].removesuffix("T00:00:00")
    return v


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)].astype(object)
    rows = [tuple(_cell(v) for v in r) for r in pdf.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def differences(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> list[str]:
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return [f"columns {sorted(spark_pdf.columns)} != {sorted(duck_pdf.columns)}"]
    kinds = [c for c in spark_pdf.columns
             if {spark_pdf[c].dtype.kind, duck_pdf[c].dtype.kind} in ({"i", "f"}, {"u", "f"})
             and not spark_pdf[c].isna().any()]  # with nulls, pandas has integers as floats
    if kinds:
        return [f"integer against float in {kinds}"]
    a, b = rows_of(spark_pdf), rows_of(duck_pdf)
    out = [] if len(a) == len(b) else [f"rows {len(a)} != {len(b)}"]
    out += [f"{x} != {y}" for x, y in zip(a, b, strict=False) if x != y][:3]
    return out
