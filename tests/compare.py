"""Compare registered queries with their SQL: ``python -m tests.compare [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/{name}.parquet')")
    return con


def cell(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime().replace(tzinfo=None)
    if isinstance(value, bool):
        return value
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return int(value) if value.is_integer() and abs(value) < 2**53 else value
    if hasattr(value, "tzinfo") and getattr(value, "tzinfo", None) is not None:
        return value.replace(tzinfo=None)
    return value


def rows_of(records, columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in records), key=lambda row: tuple((v is not None, str(type(v) if isinstance(v, str) else ""), str(v)) for v in row))


def difference(spark_df, con, sql: str) -> str | None:
    """None when rows and column names agree, otherwise a short description."""
    left_columns = spark_df.columns
    left = rows_of([tuple(r) for r in spark_df.collect()], left_columns)
    result = con.execute(sql)
    right_columns = [d[0] for d in result.description]
    right = rows_of(result.fetchall(), right_columns)
    if sorted(left_columns) != sorted(right_columns):
        return f"columns differ: only here {set(left_columns) - set(right_columns)}, only in SQL {set(right_columns) - set(left_columns)}"
    if len(left) != len(right):
        return f"{len(left)} rows here, {len(right)} in SQL"
    for a, b in zip(left, right):
        if a != b:
            names = sorted(left_columns)
            return "first difference: " + str([(n, x, y) for n, x, y in zip(names, a, b) if x != y])
    return None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from souklens import build_session

    sf = argv[0] if argv else "0.01"
    path = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(path)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    bad = 0
    for name in names:
        began = time.time()
        try:
            df = queries[name](spark, path)
            if name in oracles:
                problem = difference(df, con, oracles[name])
            else:
                problem = f"(no SQL) {df.count()} rows"
        except Exception as error:  # report and go on with the next query
            problem = f"ERROR {str(error)[:1500]}" if "-v" not in argv else traceback.format_exc()
        bad += problem is not None and not problem.startswith("(no SQL)")
        print(f"{name:45s} {time.time() - began:6.1f}s  {problem or 'ok'}", flush=True)
    print(f"{len(names)} queries, {bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1:]), 99))
