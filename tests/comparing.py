"""Rows of two engines side by side."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path


def plain(x):
    """A value as both engines show it."""
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.10g}")
    if isinstance(x, datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, date):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return x


def table_of(rows, columns) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def by_duckdb(sql: str, folder: str) -> tuple[list[str], list[tuple]]:
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    return sorted(columns), table_of(found.fetchall(), columns)


def by_spark(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), table_of([tuple(r) for r in df.collect()], df.columns)
