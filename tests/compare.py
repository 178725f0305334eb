"""Run registered queries on Spark and their SQL on DuckDB and compare rows exactly.

Usage: python tests/compare.py [sf_dir] [name ...]
"""
from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from quartier.session import build_session  # noqa: E402


def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return float(f"{v:.12g}") + 0.0
    return v


def rows_of(table):
    names = sorted(table.column_names)
    cols = [[norm(v) for v in table[n].to_pylist()] for n in names]
    return names, sorted(zip(*cols), key=repr), [str(table.schema.field(n).type) for n in names]


def compare(spark, con, sf_dir, name, fn, sql):
    start = time.time()
    got = fn(spark, sf_dir).toArrow()
    seconds = time.time() - start
    if sql is None:
        return got.num_rows > 0, f"rows only: {got.num_rows}", seconds
    want = con.sql(sql).to_arrow_table()
    gn, gr, gt = rows_of(got)
    wn, wr, wt = rows_of(want)
    if gn != wn:
        return False, f"columns {gn} != {wn}", seconds
    if len(gr) != len(wr):
        return False, f"rows {len(gr)} != {len(wr)}", seconds
    bad = [(a, b) for a, b in zip(gr, wr) if a != b]
    if bad:
        return False, f"{len(bad)} of {len(gr)} rows differ, e.g. {gn}\n      spark {bad[0][0]}\n      duck  {bad[0][1]}", seconds
    gt2 = [t.replace("large_", "") for t in gt]
    wt2 = [t.replace("large_", "") for t in wt]
    note = "" if gt2 == wt2 else f"  TYPES {[(n, a, b) for n, a, b in zip(gn, gt2, wt2) if a != b]}"
    return True, f"{len(gr)} rows{note}" + ("  EMPTY" if not gr else ""), seconds


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    oracle = entry.oracle_sql()
    failed = []
    for name, fn in entry.queries().items():
        if names and not any(name == n or name.startswith(n + "_") for n in names):
            continue
        try:
            ok, note, seconds = compare(spark, con, sf_dir, name, fn, oracle.get(name))
        except Exception as e:  # noqa: BLE001
            ok, note, seconds = False, f"{type(e).__name__}: {str(e)[:1500]}", 0.0
        print(f"{'ok  ' if ok else 'FAIL'} {name} {seconds:.1f}s {note}", flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
