"""Compare catalogue queries on Spark with their SQL on DuckDB, value by value."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry_points  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def sorted_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain_rows = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(plain_rows, key=lambda row: tuple((v is None, str(type(v)), v if v is not None else 0) for v in row))


def difference(spark, con, name: str, sf_dir: str) -> str | None:
    """None when both sides agree, else what differs."""
    frame = entry_points.queries()[name](spark, sf_dir)
    got = sorted_rows(frame.columns, frame.collect())
    result = con.execute(entry_points.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    want = sorted_rows(columns, result.fetchall())
    if sorted(frame.columns) != sorted(columns):
        return f"columns {sorted(frame.columns)} != {sorted(columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows, want {len(want)}"
    if not got:
        return "no rows"
    for x, y in zip(got, want):
        if x != y:
            return f"{sorted(columns)}\n  got  {x}\n  want {y}"
    return None


if __name__ == "__main__":
    from session import local_session

    folder = sys.argv[1]
    spark, con = local_session(), connect(folder)
    names = sys.argv[2:] or list(entry_points.queries())
    for name in names:
        begin = time.time()
        try:
            text = difference(spark, con, name, folder)
        except Exception as e:  # noqa: BLE001
            text = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'ok  ' if text is None else 'FAIL'} {name} {time.time() - begin:.1f}s {text or ''}", flush=True)
