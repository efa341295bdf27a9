"""Tables of relational stores, by JDBC or as file drops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from souklens.operators.rankings import newest_rows


def jdbc_options(
    url: str, table: str, partition_column: str, lower: str, upper: str, partitions: int, fetch: int = 10_000,
) -> dict[str, str]:
    """Options of a parallel JDBC read. Columns and filters are pushed to the database."""
    return {"url": url, "dbtable": table, "partitionColumn": partition_column, "lowerBound": lower, "upperBound": upper,
            "numPartitions": str(partitions), "fetchsize": str(fetch), "pushDownPredicate": "true",
            "pushDownLimit": "true"}


def read_jdbc(spark: SparkSession, columns: list[str], **options) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(**options)).load().select(*columns)


def read_drop(spark: SparkSession, path: str, columns: list[str], newest: tuple[str, str, int] | None = None) -> DataFrame:
    """Parquet drop of a table, reduced to ``columns``. ``newest`` = (time column, tie column,
    rows) keeps only the newest rows; by default there is no cap."""
    rows = spark.read.parquet(path).select(*columns)
    return newest_rows(rows, *newest) if newest else rows
