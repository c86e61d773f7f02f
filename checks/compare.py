"""Run registered queries and their SQL side by side: ``python -m checks.compare [names]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

from checks.oracle import ORACLE
from checks.queries import QUERIES
from duskline.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def normal(value):
    """Values compare with their type: 1 is not 1.0, and doubles are not rounded again."""
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return type(value).__name__, value


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    rows = [tuple(normal(row[name]) for name in names) for row in df.collect()]
    return names, sorted(rows, key=repr)


def sql_rows(connection, sql: str) -> tuple[list[str], list[tuple]]:
    result = connection.execute(sql)
    header = [column[0] for column in result.description]
    order = sorted(range(len(header)), key=header.__getitem__)
    rows = [tuple(normal(row[i]) for i in order) for row in result.fetchall()]
    return [header[i] for i in order], sorted(rows, key=repr)


def main() -> None:
    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark, connection = local_session("duskline-checks"), connect(sf_dir)
    for name in sys.argv[1:] or QUERIES:
        start = time.time()
        names, rows = spark_rows(QUERIES[name](spark, sf_dir))
        seconds = time.time() - start
        if name not in ORACLE:
            print(f"{name}: {len(rows)} rows, no SQL, {seconds:.2f} s")
            continue
        expected_names, expected = sql_rows(connection, ORACLE[name])
        same = (names, rows) == (expected_names, expected)
        print(f"{name}: {len(rows)} rows, {'same' if same else 'DIFFERENT'}, {seconds:.2f} s")
        if not same:
            print("  ", names, len(rows), rows[:3])
            print("  ", expected_names, len(expected), expected[:3])


if __name__ == "__main__":
    main()
