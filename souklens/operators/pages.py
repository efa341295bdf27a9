"""Pages of a large ordered result, however deep, at the cost of the rows of a page."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_PART_BITS = 33  # a row's number inside its part is below this many bits of ``monotonically_increasing_id``


class PagedResult:
    """An ordered result, stored in order with an index of how many rows stand before each part.

    ``order`` lists columns with the name of a sort method, such as ``desc_nulls_last``; all other columns complete it, so
    that equal rows alone tie. The result is range-partitioned and sorted once, each row numbered in its part;
    a page then reads the rows with its numbers, and files and row groups with others are skipped by their statistics. The
    index has a row for each part. Building runs the query once for its ranges and once for its rows: give it a stored
    table if the query is dear.
    """

    def __init__(self, spark: SparkSession, path: str, order: tuple[tuple[str, str], ...]):
        self.spark, self.path, self.order = spark, path.rstrip("/"), order

    def _columns(self, rows: DataFrame) -> list[Column]:
        named = [getattr(F.col(name), direction)() for name, direction in self.order]
        return [*named, *[F.col(c).asc() for c in rows.columns if c not in {n for n, _ in self.order} | {"_row"}]]

    def build(self, result: DataFrame) -> PagedResult:
        columns = self._columns(result)
        ordered = result.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("_row", F.monotonically_increasing_id())
        ordered.write.mode("overwrite").parquet(f"{self.path}/rows")
        part = F.shiftright("_row", _PART_BITS).alias("part")
        self.spark.read.parquet(f"{self.path}/rows").groupBy(part).agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/index")
        return self

    def spans(self, begin: int, end: int) -> list[tuple[int, int]]:
        """Stored row numbers (first, last) of the rows ``begin`` to ``end`` (exclusive) of the result, by part."""
        found, before = [], 0
        for part, n in sorted(tuple(r) for r in self.spark.read.parquet(f"{self.path}/index").collect()):  # a row a part
            first, last = max(begin - before, 0), min(end - before, n) - 1
            if first <= last:
                found.append(((part << _PART_BITS) + first, (part << _PART_BITS) + last))
            before += n
        return found

    def page(self, number: int, size: int = 1000) -> DataFrame:
        """Page ``number`` (from zero), in order; beyond the last page there are no rows."""
        rows = self.spark.read.parquet(f"{self.path}/rows")
        spans = self.spans(number * size, (number + 1) * size)
        wanted = reduce(lambda a, b: a | b, [F.col("_row").between(*s) for s in spans], F.lit(False))
        return rows.where(wanted).orderBy("_row").drop("_row")
