"""The co-purchase graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from souklens.operators import baskets
from souklens.plans import access
from souklens.sources.market import Market
from souklens.workload.datasets import BOUGHT_WITH_SQL, pairs
from souklens.workload.registry import query


@query("graph_product_vertices", "SELECT product_id AS id, name FROM products", "products")
def graph_product_vertices(m: Market) -> DataFrame:
    """Of two versions of each product the later one stays."""
    now = m.products().select("product_id", "name", "updated_at")
    before = now.select("product_id", F.concat(F.lit("old "), "name").alias("name"), F.col("updated_at") - F.expr("INTERVAL 1 DAY"))
    return baskets.product_vertices(now.union(before))


@query("graph_order_vertices", "SELECT DISTINCT order_id AS id FROM order_items", "order_items")
def graph_order_vertices(m: Market) -> DataFrame:
    return baskets.order_vertices(m.order_items())


@query("graph_contains_edges", """
    SELECT DISTINCT order_id, i.product_id FROM order_items i JOIN products p ON p.product_id = i.product_id WHERE is_active""",
    "order_items", "products")
def graph_contains_edges(m: Market) -> DataFrame:
    """Lines of products that the catalogue does not hold are dropped."""
    return baskets.contains_edges(m.order_items(), m.products().filter("is_active"))


query("graph_bought_with", "SELECT * FROM pairs", "pairs")(pairs)


@query("graph_bought_with_split", "SELECT * FROM pairs", "pairs")
def graph_bought_with_split(m: Market) -> DataFrame:
    """The same pairs when every basket of more than three lines counts as large."""
    return baskets.bought_with(m.order_items(), m.products(), split_above=3)


@query("graph_read_pairs", BOUGHT_WITH_SQL, "pairs", "products")
def graph_read_pairs(m: Market) -> DataFrame:
    return access.name_pairs(pairs(m), baskets.product_vertices(m.products()))


@query("topk_pairs", BOUGHT_WITH_SQL + " ORDER BY co_purchase_count DESC", "pairs", "products")
def topk_pairs(m: Market) -> DataFrame:
    named = access.bought_with(m.order_items(), m.products())
    return named.orderBy(F.desc("co_purchase_count"), "product_1_id", "product_2_id")
