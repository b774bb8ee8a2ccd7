"""Compare every registered query with its SQL statement, whole tables on both sides.

Usage: python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _rows(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(repr(row[i]) for i in order) for row in rows)


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty text when both sides agree, else a short account of the difference."""
    frame = query(spark, sf_dir)
    left = _rows(frame.columns, (tuple(r) for r in frame.collect()))
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    right = _rows(names, relation.fetchall())
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} against {sorted(names)}"
    if left == right:
        return "" if left else "both sides empty"
    only_left, only_right = list((left - right).items())[:2], list((right - left).items())[:2]
    return f"{sum(left.values())} rows against {sum(right.values())}; only Spark {only_left}; only SQL {only_right}"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from plumbline.session import build_session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark = build_session("local[8]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = duck(sf_dir), oracle_sql(), 0
    for name, query in queries().items():
        if args[1:] and name not in args[1:]:
            continue
        start = time.time()
        try:
            verdict = compare(spark, con, query, sql[name], sf_dir) if name in sql else "no SQL"
        except Exception as error:  # noqa: BLE001
            verdict = f"failed: {str(error)[:700]}"
        bad += bool(verdict)
        print(f"{'ok ' if not verdict else 'BAD'} {name} {time.time() - start:.1f}s {verdict[:1500]}", flush=True)
    print("all agree" if not bad else f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(bool(main()))
