"""Compare registered queries with their SQL, row by row, in DuckDB.

Run as a script: ``python tests/compare.py [folder] [name part ...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return repr(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(df, sql: str, connection) -> str | None:
    """None if equal, else what differs first."""
    columns = df.columns
    mine = _rows(columns, [tuple(r) for r in df.collect()])
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    theirs = _rows(names, result.fetchall())
    if sorted(columns) != sorted(names):
        return f"columns {sorted(columns)} != {sorted(names)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}; only here {list(set(mine) - set(theirs))[:3]}, only sql {list(set(theirs) - set(mine))[:3]}"
    if mine != theirs:
        bad = next((a, b) for a, b in zip(mine, theirs) if a != b)
        return f"first difference of {len(mine)} rows: {bad[0]} != {bad[1]}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from stratalens.session import session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    parts = args[1:]
    spark = session(os.environ.get("COMPARE_MASTER", "local[8]"), **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    connection, sqls, failed = connect(sf_dir), oracle_sql(), 0
    for name, plan in queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = plan(spark, sf_dir)
            problem = difference(df, sqls[name], connection) if name in sqls else f"{df.count()} rows, no sql"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None and name in sqls
        print(f"{'ok  ' if problem is None else 'DIFF'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
