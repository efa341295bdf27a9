"""Checks of loaded data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from souklens.operators import checks
from souklens.sources.market import Market
from souklens.workload.registry import query
from souklens.workload.storage import _ATTRIBUTES, catalogue_text


@query("check_row_counts", """
    SELECT 'marketplace_invoices' AS table_name, count(*) AS rows FROM mkt_invoices UNION ALL
    SELECT 'marketplace_invoice_lines', count(*) FROM mkt_lines UNION ALL SELECT 'orders', count(*) FROM orders_d UNION ALL
    SELECT 'order_items', count(*) FROM order_items ORDER BY table_name""", "mkt_invoices", "mkt_lines", "orders_d", "order_items")
def check_row_counts(m: Market) -> DataFrame:
    return checks.row_counts({
        "marketplace_invoices": m.marketplace_invoices(), "marketplace_invoice_lines": m.marketplace_invoice_lines(),
        "orders": m.order_headers(), "order_items": m.order_items()})


@query("check_event_profile", """
    SELECT count(*) AS total_events, count(DISTINCT event_type) AS distinct_types, min(occurred_at) AS first_at, max(occurred_at) AS last_at
    FROM events_d""", "events_d")
def check_event_profile(m: Market) -> DataFrame:
    return checks.event_profile(m.events())


def _orphans(name: str, child: str, key: str, parent: str) -> str:
    return f"""SELECT '{name}' AS link, count(*) AS orphan_rows, count(DISTINCT {key}) AS orphan_keys FROM {child}
        WHERE {key} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.id = {key})"""


@query("check_referential", " UNION ALL ".join([
    _orphans("order_item_order", "order_items", "order_id", "orders_d"), _orphans("order_invoice", "orders_d", "invoice_id", "mkt_invoices"),
    _orphans("invoice_line_invoice", "mkt_lines", "invoice_id", "mkt_invoices")]), "order_items", "orders_d", "mkt_invoices", "mkt_lines")
def check_referential(m: Market) -> DataFrame:
    return checks.referential({
        "order_item_order": (m.order_items(), "order_id", m.order_headers(), "id"),
        "order_invoice": (m.order_headers(), "invoice_id", m.marketplace_invoices(), "id"),
        "invoice_line_invoice": (m.marketplace_invoice_lines(), "invoice_id", m.marketplace_invoices(), "id")})


def _repeats(name: str, table: str, key: str) -> str:
    return f"""SELECT '{name}' AS table_name, count(*) FILTER (k IS NOT NULL AND n > 1) AS repeated_keys,
        CAST(coalesce(sum(n) FILTER (k IS NULL), 0) AS BIGINT) AS rows_without_key
        FROM (SELECT {key} AS k, count(*) AS n FROM {table} GROUP BY 1)"""


@query("check_unique_keys", " UNION ALL ".join([
    _repeats("orders", "orders_d", "id"), _repeats("order_items", "order_items", "id"),
    _repeats("marketplace_invoices", "mkt_invoices", "id"), _repeats("events_by_product", "events_d", "product_id"),
    _repeats("products", "products", "product_id")]), "orders_d", "order_items", "mkt_invoices", "events_d", "products")
def check_unique_keys(m: Market) -> DataFrame:
    return checks.unique_keys({
        "orders": (m.order_headers(), "id"), "order_items": (m.order_items(), "id"), "marketplace_invoices": (m.marketplace_invoices(), "id"),
        "events_by_product": (m.events(), "product_id"), "products": (m.products(), "product_id")})


@query("check_document_counts", f"""
    SELECT count(*) AS total_documents, count(*) FILTER (is_active) AS active_documents, count(*) FILTER ({_ATTRIBUTES} = 'parsed') AS parsed,
        count(*) FILTER ({_ATTRIBUTES} = 'broken') AS failed FROM products""", "products")
def check_document_counts(m: Market) -> DataFrame:
    return checks.document_counts(catalogue_text(m).withColumn("is_active", F.lower("is_active") == "true"))


@query("check_not_null_defaults", """
    SELECT 'status' AS column_name, count(*) FILTER (id % 9 = 0) AS missing, 0 AS missing_after FROM mkt_invoices UNION ALL
    SELECT 'discount_usd', count(*) FILTER (id % 4 = 0), 0 FROM mkt_invoices UNION ALL
    SELECT 'user_id', count(*) FILTER (id % 10 = 0), count(*) FILTER (id % 10 = 0) FROM mkt_invoices""", "mkt_invoices")
def check_not_null_defaults(m: Market) -> DataFrame:
    """Missing values of required columns before and after the column defaults are filled in."""
    loaded = m.marketplace_invoices().select(
        F.when(F.col("id") % 9 != 0, F.col("status")).alias("status"), F.when(F.col("id") % 4 != 0, F.lit(1.0)).alias("discount_usd"),
        F.when(F.col("id") % 10 != 0, F.col("user_id")).alias("user_id"))
    required = ["status", "discount_usd", "user_id"]
    filled = checks.fill_defaults(loaded, {"status": "pending", "discount_usd": 0.0})
    after = checks.null_counts(filled, required).withColumnRenamed("missing", "missing_after")
    return checks.null_counts(loaded, required).join(after, "column_name")


@query("check_price_overlaps", """
    SELECT tier_id, count(*) AS periods, count(*) FILTER (EXISTS (
        SELECT 1 FROM pricing q WHERE q.tier_id = p.tier_id AND q.id <> p.id AND q.valid_from <= p.valid_from
            AND (q.valid_to IS NULL OR q.valid_to > p.valid_from))) AS overlapping
    FROM pricing p GROUP BY 1""", "pricing")
def check_price_overlaps(m: Market) -> DataFrame:
    return checks.period_overlaps(m.tier_pricing(), "tier_id", "valid_from", "valid_to")
