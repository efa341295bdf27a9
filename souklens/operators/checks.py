"""Checks of loaded data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from souklens.functions.texts import json_or_null


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table, by table name."""
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
              for name, df in tables.items()]
    return _stack(counts).orderBy("table_name")


def event_profile(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count(F.lit(1)).alias("total_events"), F.countDistinct("event_type").alias("distinct_types"),
        F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"))


def referential(links: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Per link (child, child key, parent, parent key): children whose parent is missing.

    Children are counted per key before the join, so a key with very many rows is one row there.
    """
    def orphans(name, child, child_key, parent, parent_key):
        keys = child.filter(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
        known = parent.select(F.col(parent_key).alias("_p"))
        lost = keys.join(known, F.col("_c") == F.col("_p"), "left_anti")
        return lost.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("orphan_rows"), F.count(F.lit(1)).alias("orphan_keys")).select(
            F.lit(name).alias("link"), "orphan_rows", "orphan_keys")

    return _stack([orphans(name, *link) for name, link in links.items()])


def unique_keys(keys: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Per table: keys that occur more than once, and rows without a key."""
    def repeats(name, df, key):
        per_key = df.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
        return per_key.agg(
            F.count_if(F.col("_k").isNotNull() & (F.col("_n") > 1)).alias("repeated_keys"),
            F.coalesce(F.sum(F.when(F.col("_k").isNull(), F.col("_n"))), F.lit(0)).alias("rows_without_key"),
        ).select(F.lit(name).alias("table_name"), "repeated_keys", "rows_without_key")

    return _stack([repeats(name, *spec) for name, spec in keys.items()])


def document_counts(documents: DataFrame) -> DataFrame:
    """Documents in total and active, and how many ``attributes`` texts parsed."""
    parsed = json_or_null(F.col("attributes"))
    return documents.agg(
        F.count(F.lit(1)).alias("total_documents"),
        F.count_if("is_active").alias("active_documents"),
        F.count_if(parsed.isNotNull()).alias("parsed"),
        F.count_if(F.col("attributes").isNotNull() & parsed.isNull()).alias("failed"))


def period_overlaps(periods: DataFrame, owner: str, start: str, end: str) -> DataFrame:
    """Per owner: periods that begin before an earlier one of the same owner has ended. They make an
    as-of join return more than one row. An owner has few periods."""
    earlier = Window.partitionBy(owner).orderBy(start, F.asc_nulls_last(end)).rowsBetween(Window.unboundedPreceding, -1)
    open_before = F.max(F.col(end).isNull()).over(earlier)
    overlap = open_before | (F.max(end).over(earlier) > F.col(start))
    return periods.withColumn("_overlap", F.coalesce(overlap, F.lit(False))).groupBy(owner).agg(
        F.count(F.lit(1)).alias("periods"), F.count_if("_overlap").alias("overlapping"))


def fill_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Column defaults of the source tables for missing values."""
    return df.fillna(defaults)


def null_counts(df: DataFrame, required: list[str]) -> DataFrame:
    """Missing values per required column, one row per column."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    return counts.unpivot([], required, "column_name", "missing")
