"""Run registered queries on Spark and their checks on DuckDB, and compare the rows.

    python tests/compare.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float) and value != value:
        return "nan"
    if isinstance(value, float) and value == 0:
        return 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=lambda r: tuple((v is None, str(v)) for v in r))


def differ(name: str, spark, folder: str, queries, checks, con) -> str | None:
    """None when equal, otherwise what differs."""
    df = queries[name](spark, folder)
    got = df.collect()
    if name not in checks:
        return None if got else "no rows"
    cur = con.execute(checks[name])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} / {names}"
    a, b = rows_of(got, df.columns), rows_of(want, names)
    if len(a) != len(b):
        return f"{len(a)} rows / {len(b)} rows"
    for x, y in zip(a, b):
        if x != y or [type(v) for v in x] != [type(v) for v in y]:
            return f"{sorted(names)}: {x} / {y}"
    return None


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from loantriad.session import build_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    prefixes = tuple(argv[1:])
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in queries():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            problem = differ(name, spark, folder, queries(), oracle_sql(), con)
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {'' if name in oracle_sql() else '(rows only)'} {problem or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
