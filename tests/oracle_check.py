"""Run the registered queries beside their SQL and report differences.

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def differences(spark_rows, oracle_rows) -> str | None:
    if spark_rows[0] != oracle_rows[0]:
        return f"columns {spark_rows[0]} against {oracle_rows[0]}"
    if len(spark_rows[1]) != len(oracle_rows[1]):
        return f"{len(spark_rows[1])} rows against {len(oracle_rows[1])}"
    for ours, theirs in zip(spark_rows[1], oracle_rows[1]):
        if ours != theirs:
            return f"{ours} against {theirs}"
    return None


def check(spark, con, name: str, sf_dir: str) -> str | None:
    from __spark_entry__ import oracle_sql, queries
    df = queries()[name](spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(oracle_sql()[name])
    theirs = rows_of([c[0] for c in result.description], result.fetchall())
    return differences(ours, theirs)


def main() -> None:
    from __spark_entry__ import oracle_sql
    from offramp.session import local_session
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session(8), connect(sf_dir)
    bad = 0
    for name in sys.argv[2:] or list(oracle_sql()):
        start = time.time()
        try:
            problem = check(spark, con, name, sf_dir)
        except Exception as error:  # report every query, not only the first that fails
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{bad} differ")
    spark.stop()


if __name__ == "__main__":
    main()
