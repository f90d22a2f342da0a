"""Run a query on both engines and compare whole results, order aside."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def _bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(con: duckdb.DuckDBPyConnection, sql: str, df: DataFrame) -> str:
    """Empty when both sides agree, else what differs."""
    cursor = con.execute(sql)
    columns = [item[0] for item in cursor.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    types = {item[0]: str(item[1]) for item in cursor.description}
    wanted = _bag(columns, cursor.fetchall())
    found = _bag(df.columns, [tuple(row) for row in df.collect()])
    if wanted == found:
        return ""
    return (
        f"{sum(found.values())} rows, oracle {sum(wanted.values())} {types}\n"
        f"  only spark:  {list((found - wanted).items())[:3]}\n"
        f"  only oracle: {list((wanted - found).items())[:3]}"
    )
