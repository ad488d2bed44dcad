"""Compare every query with its SQL: ``python tests/compare.py SF_DIR [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("faultweave-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    """One form per value and type, so that 1 and 1.0 differ and dates do not."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    if isinstance(value, decimal.Decimal):
        return f"decimal {value}"
    return repr(value)


SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def normal(columns: list[tuple[str, str]], rows) -> tuple[list[tuple[str, str]], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def spark_side(spark: SparkSession, fn, sf_dir: str):
    df = fn(spark, sf_dir)
    columns = [(name, SQL_TYPES.get(kind, kind)) for name, kind in df.dtypes]
    return normal(columns, [tuple(r) for r in df.collect()])


def sql_side(con: duckdb.DuckDBPyConnection, sql: str):
    cursor = con.execute(sql)
    return normal([(d[0], str(d[1])) for d in cursor.description], cursor.fetchall())


def difference(ours, theirs) -> str:
    if ours[0] != theirs[0]:
        left, right = set(ours[0]), set(theirs[0])
        return f"columns {sorted(left - right)} against {sorted(right - left)}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} rows against {len(theirs[1])}; {_first(ours, theirs)}"
    return "" if ours[1] == theirs[1] else _first(ours, theirs)


def _first(ours, theirs) -> str:
    left, right = set(ours[1]), set(theirs[1])
    return f"only ours {sorted(left - right)[:2]}, only theirs {sorted(right - left)[:2]} ({len(left - right)} differ)"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con, sql = session(), connect(sf_dir), oracle_sql()
    failed = 0
    for name, fn in queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            ours = spark_side(spark, fn, sf_dir)
            took = time.time() - started
            started = time.time()
            wrong = difference(ours, sql_side(con, sql[name])) if name in sql else "no SQL"
            sql_took = time.time() - started
        except Exception as e:  # noqa: BLE001 - report every query
            took, ours, wrong, sql_took = time.time() - started, ([], []), f"{type(e).__name__}: {str(e)[:600]}", 0.0
        failed += bool(wrong)
        print(f"{'FAIL' if wrong else 'ok  '} {name:32s} {len(ours[1]):8d} rows {took:6.2f} s, SQL {sql_took:6.2f} s  {wrong[:1200]}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
