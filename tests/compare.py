"""Run registered queries in both engines and compare rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, name: str, run, sql: str | None):
    """(problem or None, rows, seconds)"""
    start = time.time()
    df = run(spark, sf_dir)
    ours = _rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return None, len(ours), took
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = _rows(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(ours), took
    types = {type(v) for r in ours for v in r} ^ {type(v) for r in theirs for v in r}
    if len(ours) != len(theirs):
        return f"{len(ours)} rows, expected {len(theirs)}", len(ours), took
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if bad:
        return f"{len(bad)} rows differ, e.g. {sorted(names)} {bad[0]}", len(ours), took
    return (f"types differ: {types}" if types else None), len(ours), took


def main(argv: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pulsegrain.plans.catalog import load
    from pulsegrain.session import build_session
    sf_dir, only = argv[0], argv[1:]
    spark = build_session(master="local[8]", shuffle_partitions=8, **{"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed, entries = connect(sf_dir), 0, load()
    for name, entry in entries.items():
        if only and not any(o in name for o in only):
            continue
        try:
            problem, rows, took = compare(spark, con, sf_dir, name, entry.run, entry.sql)
        except Exception as error:  # report and go on with the next query
            problem, rows, took = str(error)[:600], -1, 0.0
        mark = "ok" if problem is None and entry.sql else "rows" if problem is None else "FAIL"
        failed += problem is not None
        print(f"{mark:5}{name:32}{rows:8} {took:6.2f}s {problem or ''}", flush=True)
    print(f"{failed} failed of {len(entries)}")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
