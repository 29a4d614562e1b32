"""Compare registered queries with their SQL: ``python -m callgauge.plans.check <sf_dir> [name ...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time


def normal(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(v)
    return str(v)


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(normal(row[i]) for i in order) for row in data], key=repr), [columns[i] for i in order]


def compare(spark, con, sf_dir, name, fn, sql):
    start = time.time()
    df = fn(spark, sf_dir)
    got, got_cols = rows_of(df.columns, [tuple(x) for x in df.collect()])
    took = time.time() - start
    if sql is None:
        return ("rows-only" if got else "EMPTY"), len(got), took, ""
    cur = con.execute(sql)
    want, want_cols = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return "COLUMNS", len(got), took, f"{got_cols} vs {want_cols}"
    if got == want:
        return ("ok" if got else "ok-empty"), len(got), took, ""
    diff = [(a, b) for a, b in zip(got, want) if a != b][:2]
    return "DIFF", len(got), took, f"rows {len(got)} vs {len(want)}: {diff}"


def main(argv):
    import duckdb

    from callgauge.plans import catalog  # noqa: F401
    from callgauge.plans.registry import ORACLES, QUERIES
    from callgauge.session import get_spark

    sf_dir, names = argv[0], argv[1:]
    spark = get_spark(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
                                            "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    bad = 0
    for name, fn in QUERIES.items():
        if names and name not in names:
            continue
        try:
            status, n, took, note = compare(spark, con, sf_dir, name, fn, ORACLES.get(name))
        except Exception as e:  # one failing query must not hide the others
            status, n, took, note = "ERROR", 0, 0.0, f"{type(e).__name__}: {str(e)[:600]}"
        bad += status in ("DIFF", "COLUMNS", "ERROR", "EMPTY")
        print(f"{status:10s} {name:32s} rows={n:<7d} {took:6.2f}s {note}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
