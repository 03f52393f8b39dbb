"""Comparison of a Spark result with what DuckDB makes of the oracle SQL."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def rows(columns: list[str], records) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(record[i]) for i in order) for record in records)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None where both sides have the same columns and the same rows."""
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    want, have = rows(columns, cursor.fetchall()), rows(df.columns, df.collect())
    if want == have:
        return None
    only_have, only_want = list((have - want).elements()), list((want - have).elements())
    return (
        f"{sum(have.values())} rows against {sum(want.values())}; "
        f"only in Spark {only_have[:2]}; only in the oracle {only_want[:2]}"
    )
