"""The published catalogue: fourteen named result sets with their order."""

from __future__ import annotations

from souklens.plans.catalog import Published
from souklens.workload import datasets, reports
from souklens.workload.registry import query

#: Names and leading order columns are fixed values. Where many rows may share the leading value, a
#: key completes the order, so that a sort can split them over tasks.
CATALOG = {
    "sub-cohort": Published(datasets.sub_cohort, (
        ("cohort_month", "desc_nulls_first"), ("user_id", "asc_nulls_last"), ("subscription_id", "asc"))),
    "engagement-revenue": Published(reports.engagement_revenue, (
        ("grp_month", "asc"), ("activity_month", "desc_nulls_first"), ("grp_country", "asc"), ("country_code", "asc_nulls_last"))),
    "geo-density": Published(reports.geo_density, (("grouping_label", "desc"), ("total_orders", "desc_nulls_last"))),
    "product-affinity": Published(reports.product_affinity),
    "sub-retention": Published(reports.sub_retention, (("tier_name", "asc_nulls_last"), ("cohort_month", "desc_nulls_first"))),
    "billing-trend": Published(reports.billing_trend, (("tier_name", "asc_nulls_last"), ("billing_month", "desc_nulls_first"))),
    "funnel-conversion": Published(reports.funnel_conversion),
    "payment-behaviour": Published(reports.payment_behaviour),
    "pg-orders": Published(datasets.pg_orders, (("created_at", "desc_nulls_first"), ("id", "asc"))),
    "pg-order-items": Published(datasets.pg_order_items, (("id", "asc_nulls_last"),)),
    "pg-mkt-invoices": Published(datasets.pg_mkt_invoices, (("created_at", "desc_nulls_first"), ("id", "asc"))),
    "ts-events": Published(datasets.ts_events, (("occurred_at", "desc_nulls_first"), ("id", "asc"))),
    "mg-products": Published(datasets.mg_products, (("created_at", "desc_nulls_first"), ("product_id", "asc"))),
    "neo4j-bought-with": Published(datasets.bought_with, (
        ("co_purchase_count", "desc_nulls_first"), ("product_1_id", "asc"), ("product_2_id", "asc"))),
}

_SQL = {
    "sub-cohort": (datasets.SUB_COHORT_SQL, "sub_cohort"),
    "engagement-revenue": (reports.ENGAGEMENT_SQL, *reports.ENGAGEMENT_NEEDS),
    "geo-density": (reports.GEO_SQL, "geography"),
    "product-affinity": (reports.AFFINITY_SQL, "affinity_type"),
    "sub-retention": (reports.RETENTION_SQL, "sub_cohort"),
    "billing-trend": (reports.BILLING_SQL, *reports.BILLING_NEEDS),
    "funnel-conversion": (reports.FUNNEL_SQL, *reports.FUNNEL_NEEDS),
    "payment-behaviour": (reports.PAYMENT_SQL, *reports.PAYMENT_NEEDS),
    "pg-orders": (datasets.ORDERS_SQL, "orders_d"),
    "pg-order-items": (datasets.ORDER_ITEMS_SQL, "order_items"),
    "pg-mkt-invoices": (datasets.MKT_INVOICES_SQL, "mkt_invoices"),
    "ts-events": (datasets.EVENTS_SQL, "events_d"),
    "mg-products": (datasets.PRODUCTS_SQL, "products"),
    "neo4j-bought-with": (datasets.BOUGHT_WITH_SQL, "pairs", "products"),
}

for _name, _published in CATALOG.items():
    query("publish_" + _name.replace("-", "_"), *_SQL[_name])(_published.frame)
