"""Registration of queries and of the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from souklens.sources.market import Market
from souklens.workload.tables_sql import with_tables

BUILDERS: dict[str, Callable[[Market], DataFrame]] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def present(df: DataFrame) -> DataFrame:
    """Column types that every SQL system shows alike: decimals as doubles, days as timestamps."""
    def shown(field: T.StructField):
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            return column.cast("double").alias(field.name)
        if isinstance(field.dataType, (T.DateType, T.TimestampNTZType)):
            return column.cast("timestamp").alias(field.name)
        if isinstance(field.dataType, (T.ByteType, T.ShortType)):
            return column.cast("int").alias(field.name)
        return column
    return df.select(*[shown(f) for f in df.schema])


def query(name: str, sql: str | None = None, *needs: str):
    """Register a builder ``Market -> DataFrame`` under ``name``; ``sql`` states the same result over
    the tables ``needs``."""
    def register(build: Callable[[Market], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        BUILDERS[name] = build
        QUERIES[name] = lambda spark, path: present(build(Market(spark, path)))
        if sql is not None:
            ORACLES[name] = with_tables(sql, *needs)
        return build
    return register


def register_views(source: Market, names: list[str]) -> None:
    """Make datasets available to SQL under their names.

    ``source`` is a :class:`Market` or any object with the same methods over other tables.
    """
    for name in names:
        BUILDERS[name](source).createOrReplaceTempView(name)
