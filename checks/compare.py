"""Run registered queries against their oracle SQL.

    python -m checks.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.registry import CHECKS
from corpusguard.session import configure

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(str(r[i]) for i in order) for r in rows))


def main(sf_dir: str, names: list[str]) -> int:
    spark = (
        configure(SparkSession.builder.master(os.environ.get("COMPARE_MASTER", "local[8]")))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    failed = 0
    for name, check in CHECKS.items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            frame = check.query(spark, sf_dir)
            actual = rows_of(frame.columns, frame.collect())
        except Exception as error:  # noqa: BLE001
            print(f"ERROR {name}: {str(error)[:600]}", flush=True)
            failed += 1
            continue
        took = time.time() - started
        if check.sql is None:
            print(f"rows  {name}: {len(actual)} rows, {took:.1f}s", flush=True)
            continue
        try:
            result = connection.execute(check.sql)
            columns = [d[0] for d in result.description]
            expected = rows_of(columns, result.fetchall())
        except Exception as error:  # noqa: BLE001
            print(f"SQLERR {name}: {str(error)[:600]}", flush=True)
            failed += 1
            continue
        same = actual == expected and sorted(columns) == sorted(frame.columns)
        failed += not same
        print(f"{'ok   ' if same else 'DIFF '} {name}: {len(actual)}/{len(expected)} rows, {took:.1f}s", flush=True)
        if not same:
            print("  columns", sorted(frame.columns), sorted(columns))
            missing = [r for r in expected if r not in set(actual)][:3]
            extra = [r for r in actual if r not in set(expected)][:3]
            print("  only oracle:", missing, "\n  only spark:", extra, flush=True)
    return failed


if __name__ == "__main__":
    arguments = sys.argv[1:] or ["/root/testdata/sf0.01"]
    sys.exit(1 if main(arguments[0], arguments[1:]) else 0)
