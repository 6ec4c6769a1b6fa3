"""Run registered queries and their SQL side by side: ``python tests/oracle.py FOLDER [names...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _canonical(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_canonical(r[i]) for i in order) for r in rows), key=repr)


def differences(spark_df, con, sql: str) -> list[str]:
    """What differs between a query's rows and its SQL's; empty if nothing does."""
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = rows_of(names, cursor.fetchall())
    problems = []
    if sorted(spark_df.columns) != sorted(names):
        problems.append(f"columns {sorted(spark_df.columns)} against {sorted(names)}")
    if len(got) != len(expected):
        problems.append(f"{len(got)} rows against {len(expected)}")
    unequal = [(g, e) for g, e in zip(got, expected) if g != e]
    if unequal:
        problems.append(f"{len(unequal)} rows differ, first {unequal[0]}")
    if not expected:
        problems.append("no rows")
    return problems


if __name__ == "__main__":
    from millrace.plans import catalog
    from millrace.session import get_spark

    folder, names = sys.argv[1], sys.argv[2:]
    spark = get_spark("oracle", cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, sqls = catalog.queries(), catalog.oracle_sql()
    for name in names or queries:
        start = time.time()
        try:
            problems = differences(queries[name](spark, folder), con, sqls[name])
        except Exception as error:
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        print(f"{'ok  ' if not problems else 'FAIL'} {name} {time.time() - start:.1f}s", *problems, flush=True)
