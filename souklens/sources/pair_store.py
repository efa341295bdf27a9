"""Stored co-purchase counts, kept up to date by loads of new orders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from souklens.operators.baskets import bought_with
from souklens.session import delete, exists

_ENTRY = "number long, folder string, replaces long"


class PairStore:
    """Counts of product pairs as a sum of loads, each the pairs of orders that no load before had.

    A load's folder holds its orders and its pairs; an entry in the log, written last, makes both count. A load that died
    leaves a folder that nobody reads, and the same orders given again, in part or whole, add nothing. So an order counts
    with the lines that it had when it was first given; hand over whole orders. ``compact`` sums all loads up to now as one
    and drops those. There is one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _loads(self) -> list[Row]:
        """Entries that count: those after the last compaction, and it."""
        where = f"{self.path}/log"
        log = self.spark.read.schema(_ENTRY).json(where).orderBy("number").collect() if exists(self.spark, where) else []
        least = max((e["replaces"] for e in log), default=0)
        return [e for e in log if e["number"] > least]

    def _read(self, loads: list[Row], kind: str, schema: str) -> DataFrame:
        paths = [f"{e['folder']}/{kind}" for e in loads]
        return self.spark.read.parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _commit(self, folder: str, replaces: int) -> None:
        loads = self._loads()
        number = (loads[-1]["number"] if loads else 0) + 1
        self.spark.createDataFrame([(number, folder, replaces)], _ENTRY).coalesce(1).write.mode("append").json(f"{self.path}/log")

    def add(self, items: DataFrame, products: DataFrame) -> None:
        """Count the orders of ``items`` (order_id, product_id) that have not been counted."""
        done = self._read(self._loads(), "orders", f"order_id {items.schema['order_id'].dataType.simpleString()}")
        new = items.join(done, "order_id", "left_anti").select("order_id", "product_id")
        folder = f"{self.path}/load-{uuid.uuid4().hex}"
        new.write.parquet(f"{folder}/lines")
        lines = self.spark.read.parquet(f"{folder}/lines")
        lines.select("order_id").distinct().write.parquet(f"{folder}/orders")
        bought_with(lines, products).write.parquet(f"{folder}/pairs")
        delete(self.spark, f"{folder}/lines")
        self._commit(folder, 0)

    def pairs(self) -> DataFrame:
        """The pairs of all orders so far with their numbers of orders."""
        rows = self._read(self._loads(), "pairs", "product_1_id long, product_2_id long, co_purchase_count long")
        return rows.groupBy("product_1_id", "product_2_id").agg(F.sum("co_purchase_count").alias("co_purchase_count"))

    def compact(self) -> None:
        """Sum the loads as one. Readers that began before must be done, as the loads are deleted."""
        loads = self._loads()
        if len(loads) < 2:
            return
        folder = f"{self.path}/load-{uuid.uuid4().hex}"
        self._read(loads, "orders", "").write.parquet(f"{folder}/orders")
        self.pairs().write.parquet(f"{folder}/pairs")
        self._commit(folder, loads[-1]["number"])
        for e in loads:
            delete(self.spark, e["folder"])
