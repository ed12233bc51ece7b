"""Compare registered queries with their SQL, run as `python tests/oracle_check.py SF_DIR [name ...]`."""

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


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def _cell(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return f"{type(value).__name__}:{value}"


def _table(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(spark_frame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs between the two results, None if nothing does."""
    columns, ours = _table(spark_frame.columns, [tuple(row) for row in spark_frame.collect()])
    result = connection.execute(sql)
    names, theirs = _table([d[0] for d in result.description], result.fetchall())
    if columns != names:
        return f"columns {columns} against {names}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(wrong)} of {len(ours)} rows differ, e.g. {wrong[0]}" if wrong else None


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    connection, oracle = connect(sf_dir), entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        began = time.time()
        try:
            if name in oracle:
                found = difference(query(spark, sf_dir), connection, oracle[name])
            else:
                found = f"rows only: {len(query(spark, sf_dir).collect())}"
        except Exception as error:  # report every query
            found = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        bad += name in oracle and found is not None or "ERROR" in str(found)
        print(f"{time.time() - began:6.2f}s  {name:24} {found or 'ok'}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
