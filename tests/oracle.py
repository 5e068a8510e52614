"""Run registered queries against DuckDB on the same tables."""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

from codeloom.plans import catalog
from codeloom.plans.fixtures import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return f"{value:.9g}"
    return f"{type(value).__name__}:{value}"


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = catalog.QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if name not in catalog.ORACLES:
        return None
    cursor = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(columns)}"
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a != b:
        return (f"{len(got)} rows instead of {len(want)}; only here {list((a - b).items())[:2]}; "
                f"only there {list((b - a).items())[:2]}; columns {sorted(columns)}")
    return None if want else "no rows"


if __name__ == "__main__":
    from codeloom.session import local_session

    directory = sys.argv[1]
    names = sys.argv[2:] or list(catalog.QUERIES)
    session = local_session("8")
    session.sparkContext.setLogLevel("ERROR")
    database = connect(directory)
    bad = 0
    for query_name in names:
        began = time.time()
        try:
            problem = compare(session, database, query_name, directory)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__} {str(error)[:700]}"
        kind = "" if query_name in catalog.ORACLES else " (rows only)"
        print(f"{query_name}{kind} {time.time() - began:.1f}s", "ok" if problem is None else f"FAIL {problem}", flush=True)
        bad += problem is not None
    print("failed:", bad, "of", len(names))
