"""Compare registered queries with their SQL on the same files: ``python tests/oracle_check.py [pattern] [sf]``."""

from __future__ import annotations

import glob
import math
import os
import re
import sys
import time

import duckdb

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(norm(r[i]) for i in order) for r in rows], key=repr)


def connect(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def compare(spark, con, sf, name, fn, sql):
    """Returns (ok, message)."""
    df = fn(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return True, f"rows only: {len(got)}"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(df.columns) != sorted(cols):
        return False, f"columns {sorted(df.columns)} vs {sorted(cols)}"
    if len(got) != len(want):
        return False, f"rows {len(got)} vs {len(want)}; {got[:2]} vs {want[:2]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return not bad, f"{len(got)} rows" if not bad else f"{len(bad)} of {len(got)} differ: {bad[:2]}"


def main():
    pattern = sys.argv[1] if len(sys.argv) > 1 else "."
    sf = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.01"
    from conftest import make_session

    import __spark_entry__ as e

    spark, con = make_session(), connect(sf)
    failed = []
    for name, fn in e.queries().items():
        if not re.search(pattern, name):
            continue
        t = time.time()
        try:
            ok, message = compare(spark, con, sf, name, fn, e.oracle_sql().get(name))
        except Exception as exc:  # report and go on with the next query
            ok, message = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        failed += [] if ok else [name]
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.1f}s {message}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
