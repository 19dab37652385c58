"""Compares a query with its SQL in DuckDB on one data directory."""

from __future__ import annotations

import decimal
from pathlib import Path

import duckdb


def _text(v: object) -> str:
    if v is None or v != v:
        return ""
    return f"{v:.6g}" if isinstance(v, (float, decimal.Decimal)) else str(v)


def _table(rows, columns) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_text(r[i]) for i in order) for r in rows)


def against_sql(df, sql: str, directory: Path) -> None:
    with duckdb.connect() as c:
        for p in directory.glob("*.parquet"):
            c.execute(f"create view {p.stem} as select * from '{p}'")
        r = c.execute(sql)
        names = [x[0] for x in r.description]
        want = _table(r.fetchall(), names)
    assert sorted(names) == sorted(df.columns)
    assert _table(df.collect(), df.columns) == want
