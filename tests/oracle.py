"""Run registered queries next to their SQL and compare the results.

    python -m tests.oracle [--sf 0.01] [names...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def _plain(value):
    if isinstance(value, bool):
        return int(value)
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    number = float(value)
    return "nan" if math.isnan(number) else number


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def difference(df, sql: str, connection, took: list | None = None) -> str | None:
    """What differs between a DataFrame and a query, or None."""
    start = time.time()
    collected = df.collect()
    if took is not None:
        took.append(time.time() - start)
    actual = _rows(df.columns, collected)
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    expected = _rows(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    if len(actual) != len(expected):
        return f"{len(actual)} rows vs {len(expected)}; first {actual[:2]} vs {expected[:2]}"
    pairs = [(a, e) for a, e in zip(actual, expected) if a != e]
    if pairs:
        return f"{len(pairs)} of {len(actual)} rows differ; first {pairs[0][0]} vs {pairs[0][1]}"
    return None


def main() -> int:
    from notewright.plans.catalog import CATALOG
    from notewright.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    options = parser.parse_args()
    folder = f"/root/testdata/sf{options.sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    failed = 0
    for name in options.names or CATALOG:
        query = CATALOG[name]
        start, took = time.time(), []
        try:
            df = query.run(spark, folder)
            took = [time.time() - start]
            problem = difference(df, query.sql, connection, took) if query.sql else f"no SQL, {len(df.collect())} rows"
            bad = query.sql is not None and problem is not None
        except Exception as failure:
            problem, bad = f"{type(failure).__name__}: {str(failure)[:1500]}", True
        failed += bad
        print(f"{'FAIL' if bad else 'ok  '} {name} spark {sum(took):.1f}s all {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main() > 0)
