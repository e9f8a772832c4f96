"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tests/oracle_compare.py [sf_dir] [query ...]
Prints one line per query: status, rows, and the first difference.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    import datetime

    import pandas as pd

    if v is None:
        return None
    import numpy as np

    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return str(sorted(v.items()))
    try:
        if pd.isna(v):
            return None
    except (TypeError, ValueError):
        pass
    if isinstance(v, pd.Timestamp):
        v = v.to_pydatetime()
    if isinstance(v, datetime.datetime) and v.time() == datetime.time(0):
        return v.date()
    if isinstance(v, float):
        return v
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = [tuple(norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    sp = sdf.toPandas()
    ts = time.time() - t0
    if sql is None:
        return f"{name:32s} rows-only  spark={len(sp)} ({ts:.1f}s)"
    t0 = time.time()
    dp = con.execute(sql).df()
    td = time.time() - t0
    sc, sr = rows_of(sp)
    dc, dr = rows_of(dp)
    if sc != dc:
        return f"{name:32s} COLS DIFFER spark={sc} duck={dc}"
    if len(sr) != len(dr):
        return f"{name:32s} ROWCOUNT spark={len(sr)} duck={len(dr)}"
    for a, b in zip(sr, dr):
        if a != b:
            return f"{name:32s} VALUE DIFF\n   spark={a}\n   duck ={b}"
    return f"{name:32s} OK rows={len(sr)} spark={ts:.1f}s duck={td:.2f}s"


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    from shelfrank.session import local_session
    import __spark_entry__ as e

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, sqls = e.queries(), e.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        try:
            line = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as ex:  # noqa: BLE001
            line = f"{name:32s} ERROR {type(ex).__name__}: {str(ex)[:400]}"
        if " OK " not in line and "rows-only" not in line:
            bad += 1
        print(line, flush=True)
    print(f"{bad} failing")


if __name__ == "__main__":
    main()
