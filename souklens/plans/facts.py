"""Measures at event, order, subscription and user-month grain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from souklens.functions.numbers import flag, nvl
from souklens.functions.times import days_between, month_in, month_of, plus_days, second_of
from souklens.operators.intervals import valid_at_join
from souklens.operators.joins import detail_left_join


def user_subscription(users: DataFrame, subscriptions: DataFrame, tiers: DataFrame, pricing: DataFrame) -> DataFrame:
    """Subscriptions with user, plan and the price that was valid when they started.

    Overlapping price periods yield one row each, a missing period leaves the price NULL. Cuts the periods
    into bins when the frame is built (see ``valid_at_join``).
    """
    u = users.select(F.col("id").alias("user_id"), "email", "full_name", "country_code", "city",
                     F.col("created_at").alias("user_created_at"), "last_login_at", F.col("is_active").alias("user_is_active"))
    s = subscriptions.select(
        F.col("id").alias("sub_id"), F.col("user_id").alias("_user"), F.col("status").alias("sub_status"), "started_at",
        "current_period_start", "current_period_end", "cancelled_at", "cancel_reason", "billing_cycle",
        F.col("created_at").alias("sub_created_at"), F.col("updated_at").alias("sub_updated_at"), "tier_id")
    t = tiers.select(F.col("id").alias("_tier"), F.col("name").alias("tier_name"), F.col("description").alias("tier_description"))
    p = pricing.select(F.col("id").alias("price_id"), F.col("tier_id").alias("_priced"), "monthly_price_usd",
                       F.col("valid_from").alias("price_valid_from"), F.col("valid_to").alias("price_valid_to"),
                       F.col("is_active").alias("price_is_active"))
    priced = valid_at_join(s, p, "tier_id", "started_at", "_priced", "price_valid_from", "price_valid_to")
    return priced.join(u, F.col("user_id") == F.col("_user")).join(t, F.col("tier_id") == F.col("_tier"), "left").select(
        "user_id", "email", "full_name", "country_code", "city", "user_created_at", "last_login_at", "user_is_active",
        "sub_id", "sub_status", "started_at", "current_period_start", "current_period_end", "cancelled_at", "cancel_reason",
        "billing_cycle", "sub_created_at", "sub_updated_at", "tier_id", "tier_name", "tier_description", "price_id",
        "monthly_price_usd", "price_valid_from", "price_valid_to", "price_is_active")


def sub_billing(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """Subscription invoices with their lines; an invoice without lines keeps one row. Counts a sample of
    the lines when the frame is built (see ``detail_left_join``)."""
    i = invoices.select(
        F.col("id").alias("invoice_id"), "user_id", "invoice_type", F.col("status").alias("invoice_status"), "subtotal_usd",
        "tax_usd", "discount_usd", "total_usd", "subscription_id", "billing_period_start", "billing_period_end", "paid_at",
        "due_at", F.col("created_at").alias("invoice_created_at"))
    line = lines.select(
        F.col("invoice_id").alias("_invoice"), F.col("id").alias("line_item_id"), "product_id",
        F.col("description").alias("line_description"), "quantity", "unit_price_usd", "line_total_usd",
        F.col("created_at").alias("line_created_at"))
    return detail_left_join(i, line, "invoice_id", "_invoice").drop("_invoice")


def order_transactions(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders with their lines; an order without lines keeps one row. Counts a sample of the lines when
    the frame is built (see ``detail_left_join``)."""
    o = orders.select(F.col("id").alias("order_id"), "user_id", "invoice_id", "status", "shipping_country", "created_at")
    i = items.select(F.col("order_id").alias("_order"), "id", "product_id", "quantity", "unit_price_usd", "line_total_usd")
    return detail_left_join(o, i, "order_id", "_order").drop("_order")


def user_orders(users: DataFrame, orders: DataFrame, items: DataFrame, marketplace_invoices: DataFrame) -> DataFrame:
    """Order lines with user and order and, where there is one, the marketplace invoice."""
    u = users.select("id", "email", "full_name", "country_code", "city")
    o = orders.select(
        F.col("id").alias("order_id"), F.col("user_id").alias("_user"), F.col("invoice_id").alias("_invoice"),
        F.col("status").alias("order_status"), "shipping_country", F.col("created_at").alias("order_created_at"))
    m = marketplace_invoices.select(F.col("id").alias("marketplace_invoice_id"), F.col("status").alias("invoice_status"))
    i = items.select(F.col("order_id").alias("_order"), "product_id", "quantity", "unit_price_usd", "line_total_usd")
    # The one-row-per-order joins come first, so the lines are moved once.
    headers = o.join(u, F.col("id") == F.col("_user")).join(m, F.col("_invoice") == F.col("marketplace_invoice_id"), "left")
    return headers.join(i, F.col("order_id") == F.col("_order")).select(
        "id", "email", "full_name", "country_code", "city", "order_id", "order_status", "shipping_country",
        "order_created_at", "marketplace_invoice_id", "invoice_status", "product_id", "quantity", "unit_price_usd",
        "line_total_usd")


def sub_cohort(subscription: DataFrame, now: Column) -> DataFrame:
    """Start month, days active, retention after 30 and 90 days and churn of each subscription.

    ``subscription`` comes from :func:`user_subscription`. A subscription that neither ended nor
    has a period end counts its days up to ``now`` but not as retained, as the source model does.
    """
    start, cancelled = second_of(F.col("started_at")), second_of(F.col("cancelled_at"))
    end = F.coalesce(cancelled, second_of(F.col("current_period_end")))
    return subscription.select(
        "user_id", F.col("email").alias("user_email"), F.col("full_name").alias("user_full_name"),
        F.col("country_code").alias("user_country_code"), F.col("city").alias("user_city"),
        F.col("sub_id").alias("subscription_id"), "tier_id", "tier_name", F.col("sub_status").alias("subscription_status"),
        "billing_cycle", "started_at", "current_period_start", "current_period_end", "cancelled_at", "cancel_reason",
        "monthly_price_usd",
        month_of(start).alias("cohort_month"),
        days_between(F.coalesce(end, now), start).alias("days_active"),
        flag(end >= plus_days(start, 30)).alias("retained_30d"),
        flag(end >= plus_days(start, 90)).alias("retained_90d"),
        flag(F.col("cancelled_at").isNotNull()).alias("churned_flag"))


#: Counter name -> event type. Fixed values.
EVENT_COUNTERS = {
    "page_views": "page_view",
    "product_views": "product_view",
    "searches": "search",
    "add_to_cart_events": "add_to_cart",
    "checkout_starts": "checkout_start",
    "purchase_events": "purchase",
}


def activity_by_user_month(events: DataFrame) -> DataFrame:
    """Event counters per user and month, before any join: a very active user is reduced to
    one row per month inside each task."""
    return events.groupBy(F.col("user_id"), month_in(events, "occurred_at").alias("activity_month")).agg(
        F.count(F.lit(1)).alias("total_events"),
        *[F.count_if(F.col("event_type") == kind).alias(name) for name, kind in EVENT_COUNTERS.items()])


def sales_by_user_month(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders with lines, quantity and revenue per user and month.

    Lines are summed per order before the join. Order ids are unique, so the rows of the join
    count the distinct orders.
    """
    per_order = items.groupBy(F.col("order_id").alias("_order")).agg(
        F.sum(nvl(F.col("quantity"), 0)).alias("_quantity"),
        F.sum(nvl(F.col("line_total_usd"), 0)).alias("_revenue"))
    o = orders.select(F.col("id").alias("_id"), "user_id", month_in(orders, "created_at").alias("order_month"))
    return o.join(per_order, F.col("_id") == F.col("_order")).groupBy("user_id", "order_month").agg(
        F.count(F.lit(1)).alias("order_count"), F.sum("_quantity").alias("total_quantity"),
        F.sum("_revenue").alias("total_revenue_usd"))


def user_engagement_sales(users: DataFrame, events: DataFrame, orders: DataFrame, items: DataFrame) -> DataFrame:
    """Activity of each user and month with the sales of the same user and month.

    Sales without activity in the same month do not appear, as in the source model.
    """
    u = users.select(F.col("id").alias("_id"), F.col("country_code").alias("user_country_code"))
    activity = activity_by_user_month(events).join(u, F.col("user_id") == F.col("_id"))
    sales = sales_by_user_month(orders, items).withColumnRenamed("user_id", "_buyer")
    same = (F.col("user_id") == F.col("_buyer")) & (F.col("activity_month") == F.col("order_month"))
    return activity.join(sales, same, "left").select(
        "user_id", "user_country_code", "activity_month", "total_events", *EVENT_COUNTERS,
        nvl(F.col("order_count"), 0).alias("order_count"),
        nvl(F.col("total_quantity"), 0).alias("total_quantity"),
        F.coalesce(F.col("total_revenue_usd"), F.lit(0).cast("decimal(22,2)")).alias("total_revenue_usd"))
