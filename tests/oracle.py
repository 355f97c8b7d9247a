"""Run registered queries against their SQL twins and report differences.

    python tests/oracle.py [folder] [name prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    """Comparable form that keeps integers, floats and text apart."""
    if value is None:
        return ("none",)
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, float):
        return ("none",) if math.isnan(value) else ("float", repr(value))
    if isinstance(value, int):
        return ("int", value)
    return (type(value).__name__, str(value))


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()]), sorted(df.columns)


def sql_rows(con, sql: str):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return rows_of(names, cur.fetchall()), sorted(names)


def compare(spark, con, query, sf_dir: str) -> tuple[bool, str]:
    got, got_names = spark_rows(query(spark, sf_dir))
    if query.sql is None:
        return len(got) > 0, f"{len(got)} rows (rows only)"
    want, want_names = sql_rows(con, query.sql)
    if got_names != want_names:
        return False, f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return False, f"{len(got)} rows != {len(want)}"
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b]
        return False, f"{len(diff)} rows differ {got_names}: {diff[0]}"
    return True, f"{len(got)} rows"


if __name__ == "__main__":
    from emberscope.plans.catalog import QUERIES
    from emberscope.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = build_session("check", os.environ.get("ORACLE_MASTER", "local[8]"), 8, {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, q in QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        if os.environ.get("SQL_ONLY") and q.sql is None:
            continue
        start = time.time()
        try:
            ok, note = compare(spark, con, q, folder)
        except Exception as e:  # report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:34s} {time.time() - start:6.2f}s {note}", flush=True)
    print("failures:", bad)
