"""Run a named query on Spark and its SQL on DuckDB and compare all values.

    python -m tests.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def local_session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        path = Path(sf_dir) / f"{table}.parquet"
        if path.exists():
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _rows(columns: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(0.0 if row[i] == 0 and isinstance(row[i], float) else row[i] for i in order) for row in rows)


def differences(spark_df, connection, sql: str) -> str | None:
    """None when both sides hold the same columns and rows, else what differs."""
    result = connection.execute(sql)
    theirs_columns = [d[0] for d in result.description]
    theirs = _rows(theirs_columns, result.fetchall())
    ours = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(spark_df.columns) != sorted(theirs_columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(theirs_columns)}"
    if ours != theirs:
        missing, extra = list((theirs - ours).items()), list((ours - theirs).items())
        return f"{sum(ours.values())} vs {sum(theirs.values())} rows\n  spark {extra[:3]}\n  sql   {missing[:3]}"
    if not ours:
        return "no rows"
    return None


def main() -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, connection = local_session(), duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for name, build in queries.items():
        if name not in (wanted or oracles):
            continue
        start = time.time()
        try:
            problem = differences(build(spark, sf_dir), connection, oracles[name])
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
