"""Compare registered queries with their SQL on DuckDB: python tests/check.py SF [names]."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA:
            return "NULL"
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float):
            return "NULL" if v != v else repr(v if v != int(v) else int(v)) if abs(v) < 1e15 else repr(v)
        if isinstance(v, pd.Timestamp):
            return v.isoformat()
        return str(v)

    columns = sorted(df.columns)
    return sorted(tuple(cell(v) for v in row) for row in df[columns].astype(object).itertuples(index=False))


def compare(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns differ: {sorted(spark_df.columns)} / {sorted(sql_df.columns)}"
    a, b = canonical(spark_df), canonical(sql_df)
    if len(a) != len(b):
        return f"row counts differ: {len(a)} / {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"first difference:\n  spark {x}\n  sql   {y}"
    return None


def run(spark, sf: str, names: list[str] | None = None) -> list[str]:
    from __spark_entry__ import oracle_sql, queries

    con = connect(sf)
    bad = []
    sqls = oracle_sql()
    for name, fn in queries().items():
        if names and name not in names:
            continue
        try:
            t0 = time.time()
            got = fn(spark, sf).toPandas()
            t1 = time.time()
            if name in sqls:
                want = con.execute(sqls[name]).df()
                problem = compare(got, want)
                note = "sql"
            else:
                problem, note = None, "rows only"
            t2 = time.time()
        except Exception as exc:
            problem, t1, t2, note, got = f"{type(exc).__name__}: {str(exc)[:1500]}", t0, t0, "", []
        print(f"{'FAIL' if problem else 'ok  '} {name:28s} rows={len(got):<7d} spark={t1 - t0:6.2f}s sql={t2 - t1:5.2f}s {note}", flush=True)
        if problem:
            bad.append(name)
            print("   ", problem, flush=True)
    return bad


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    failed = run(session, sys.argv[1], sys.argv[2:] or None)
    print("failed:", failed)
