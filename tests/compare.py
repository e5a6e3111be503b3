"""Run registered queries on Spark and their SQL on DuckDB, and compare whole results.

    python tests/compare.py FOLDER [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_value(x) for x in v)
    return v


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, name, fn, sql):
    """(ok, message)"""
    start = time.time()
    df = fn(spark, folder)
    got = [tuple(r) for r in df.collect()]
    mid = time.time()
    if not sql:
        return True, f"{name}: {len(got)} rows, no SQL, {mid - start:.1f}s"
    cur = con.execute(sql)
    names, want = [d[0] for d in cur.description], cur.fetchall()
    text = f"{name}: {len(got)} rows, spark {mid - start:.1f}s, sql {time.time() - mid:.1f}s"
    if sorted(names) != sorted(df.columns):
        return False, f"{text}: columns {df.columns} != {names}"
    a, b = normal(df.columns, got), normal(names, want)
    if a != b:
        odd = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"{text}: {len(a)} vs {len(b)} rows, first differences {odd}"
    return True, text


def main():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from conftest import make_session
    from polyweave.suite import registered
    folder, wanted = sys.argv[1], sys.argv[2:]
    spark, con = make_session(), connect(folder)
    failed = 0
    for name, (fn, sql) in registered().items():
        if wanted and name not in wanted:
            continue
        try:
            ok, text = compare(spark, con, folder, name, fn, sql)
        except Exception as e:  # report and go on with the next query
            ok, text = False, f"{name}: {type(e).__name__} {str(e)[:600]}"
        failed += not ok
        print("ok  " if ok else "FAIL", text, flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
