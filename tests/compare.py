"""Run queries in Spark and their SQL in DuckDB and compare the rows.

    python tests/compare.py [sf] [name-prefix …]
"""

from __future__ import annotations

import datetime
import glob
import os
import sys
import time

import duckdb
import numpy as np

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def _norm(v):
    if isinstance(v, (np.floating, float)):
        return None if v != v else float(v)
    if isinstance(v, (np.integer,)):
        return int(v)
    if isinstance(v, np.ndarray):
        return tuple(_norm(x) for x in v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def difference(df, con, sql: str) -> str | None:
    """None if equal, else what differs first."""
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    theirs = rows_of(cols, cur.fetchall())
    ours = rows_of(df.columns, df.collect())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(cols)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            names = sorted(cols)
            bad = [(n, x, y) for n, x, y in zip(names, a, b) if x != y]
            return f"{bad[:4]} in {a}"
    if not ours:
        return "both empty"
    return None


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.extraJavaOptions", "-XX:TieredStopAtLevel=1 -XX:ReservedCodeCacheSize=512m")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def main(argv: list[str]) -> int:
    sf = argv[0] if argv else "0.001"
    prefixes = tuple(argv[1:])
    import __spark_entry__ as entry

    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    path = f"/root/testdata/sf{sf}"
    con = duck(path)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        t = time.time()
        try:
            df = fn(spark, path)
            if name in oracles:
                problem = difference(df, con, oracles[name])
            else:
                n = len(df.collect())
                problem = None if n else "no rows"
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:900]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {time.time() - t:6.2f}s {name} {'' if name in oracles else '(rows only)'} {problem or ''}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
