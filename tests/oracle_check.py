"""Run every query beside its SQL on DuckDB and compare the results.

python tests/oracle_check.py [folder] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from inquest.session import local_session  # noqa: E402


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.6g}" if abs(float(v)) < 1e15 else f"{float(v):.5g}"
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, name) -> tuple[str, float]:
    start = time.time()
    try:
        df = entry.queries()[name](spark, folder)
        mine = table(df.columns, [tuple(r) for r in df.collect()])
    except Exception as error:  # noqa: BLE001
        return f"ERROR spark: {str(error)[:300]}", time.time() - start
    took = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows only ({len(mine[1])})", took
    try:
        found = con.execute(sql)
        theirs = table([d[0] for d in found.description], found.fetchall())
    except Exception as error:  # noqa: BLE001
        return f"ERROR sql: {str(error)[:300]}", took
    if mine[0] != theirs[0]:
        return f"DIFF columns {mine[0]} {theirs[0]}", took
    if mine[1] != theirs[1]:
        a, b = set(mine[1]) - set(theirs[1]), set(theirs[1]) - set(mine[1])
        return (f"DIFF rows {len(mine[1])}/{len(theirs[1])}, {len(a)} differ: "
                f"{sorted(a)[:2]} {sorted(b)[:2]}")[:600], took
    return f"ok ({len(mine[1])})", took


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = local_session(cpus=8)
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    bad = 0
    for name in names:
        result, took = compare(spark, con, folder, name)
        bad += not result.startswith(("ok", "rows"))
        print(f"{took:6.2f}s {name:34s} {result}", flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
