"""Run a registered query in Spark and its SQL in DuckDB and compare the two."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


def canonical(columns: list[str], rows) -> tuple[list[str], list]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark_df, con, sql: str) -> str | None:
    mine = canonical(spark_df.columns, spark_df.collect())
    cursor = con.execute(sql)
    other = canonical([d[0] for d in cursor.description], cursor.fetchall())
    if mine[0] != other[0]:
        return f"columns {mine[0]} != {other[0]}"
    if len(mine[1]) != len(other[1]):
        return f"{len(mine[1])} rows != {len(other[1])}"
    for a, b in zip(mine[1], other[1]):
        if a != b:
            return f"spark {a!r} != sql {b!r}"
    return None
