"""Run registered queries beside their SQL twins and report differences.

Usage: python -m driver_checks.compare <folder> [name-prefix ...]
"""

from __future__ import annotations

import os
import sys
import threading
import time

import duckdb
import pandas as pd

from driver_checks import oracle_sql, queries
from voxtable.session import build_session

TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}


def views(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in sorted(os.listdir(folder)):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{folder}/{name}'")
    return con


def rows_of(names: list[str], rows: list) -> pd.DataFrame:
    frame = pd.DataFrame([tuple(r) for r in rows], columns=names, dtype=object)
    columns = sorted(names)
    text = frame[columns].map(lambda v: "null" if v is None or v != v else f"{v:.5f}" if isinstance(v, float) else str(v))
    return text.sort_values(columns).reset_index(drop=True)


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both sides agree in columns, types, rows and values."""
    limit = threading.Timer(90, con.interrupt)
    limit.start()
    try:
        result = con.execute(sql)
        expected_rows = result.fetchall()
    finally:
        limit.cancel()
    names, kinds = [d[0] for d in result.description], [str(d[1]) for d in result.description]
    expected = rows_of(names, expected_rows)
    got = rows_of(df.columns, df.collect())
    ours = {n: TYPES.get(k, k) for n, k in df.dtypes}
    theirs = dict(zip(names, kinds))
    if ours != theirs:
        return f"types: {sorted(set(ours.items()) ^ set(theirs.items()))}"
    if len(got) != len(expected):
        return f"rows: {len(got)} against {len(expected)}"
    wrong = (got != expected).any(axis=1)
    if wrong.any():
        return f"{wrong.sum()} of {len(got)} rows differ:\n{got[wrong].head(3)}\n{expected[wrong].head(3)}"
    return None


def main(folder: str, prefixes: list[str]) -> int:
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, bad = views(folder), oracle_sql(), 0
    for name, query in queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            if name in oracle:
                problem = difference(query(spark, folder), con, oracle[name])
            else:
                problem = None
                print(f"     {name}: {query(spark, folder).count()} rows, no SQL twin")
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} differences")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
