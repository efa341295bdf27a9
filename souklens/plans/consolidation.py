"""Cross-store views: one relational model over users, events, products, sellers, orders, invoices."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from souklens.functions.times import as_timestamp

_PRODUCT = {"name": "product_name", "product_type": "product_type", "seller_id": "seller_id",
            "price_usd": "product_price_usd", "is_active": "product_is_active"}


def user_activity(users: DataFrame, events: DataFrame, products: DataFrame) -> DataFrame:
    """Events with their user and, where it is known, their product; event time as a timestamp."""
    e = events.select(
        F.col("id").alias("event_id"), F.col("user_id").alias("_user"), "event_type", "product_id", "metadata",
        as_timestamp(events, "occurred_at").alias("occurred_at"))
    p = products.select(F.col("product_id").alias("_product"), *[F.col(c).alias(a) for c, a in _PRODUCT.items()])
    return users.join(e, F.col("id") == F.col("_user")).join(p, F.col("product_id") == F.col("_product"), "left").select(
        "id", "email", "full_name", "country_code", "city", "created_at", "last_login_at", "is_active",
        "event_id", "event_type", "product_id", "metadata", "occurred_at", *_PRODUCT.values())


def product_affinity(pairs: DataFrame, products: DataFrame) -> DataFrame:
    """Co-purchase pairs with the catalogue entry of both products."""
    out = pairs
    for side in (1, 2):
        p = products.select(
            F.col("product_id").alias(f"_p{side}"), F.col("name").alias(f"product_{side}_name"),
            F.col("product_type").alias(f"product_{side}_type"), F.col("price_usd").alias(f"product_{side}_price"),
            F.col("seller_id").alias(f"product_{side}_seller_id"))
        out = out.join(p, F.col(f"product_{side}_id") == F.col(f"_p{side}"), "left")
    fields = ("id", "name", "type", "price", "seller_id")
    return out.select(*[f"product_{side}_{field}" for side in (1, 2) for field in fields], "co_purchase_count")


def seller_order_revenue(sellers: DataFrame, products: DataFrame, items: DataFrame, orders: DataFrame) -> DataFrame:
    """Order lines with their order, product and seller; lines without any of them are left out."""
    s = sellers.select(F.col("user_id").alias("_seller"), "display_name", "country_code", "is_verified")
    p = products.select("product_id", "seller_id", "name", "product_type")
    i = items.select(F.col("id").alias("order_item_id"), F.col("order_id").alias("_order"), F.col("product_id").alias("_product"),
                     "quantity", "unit_price_usd", "line_total_usd")
    o = orders.select(F.col("id").alias("order_id"), F.col("user_id").alias("buyer_user_id"),
                      F.col("status").alias("order_status"), "shipping_country", "created_at")
    offered = p.join(s, F.col("seller_id") == F.col("_seller"))
    return i.join(o, F.col("_order") == F.col("order_id")).join(offered, F.col("_product") == F.col("product_id")).select(
        "seller_id", "display_name", "country_code", "is_verified", "product_id", "name", "product_type", "order_id",
        "buyer_user_id", "order_status", "shipping_country", "created_at", "order_item_id", "quantity",
        "unit_price_usd", "line_total_usd")


def user_names(users: DataFrame) -> DataFrame:
    return users.select(F.col("id").alias("user_id_ref"), "full_name")


def invoices(subscription_invoices: DataFrame, marketplace_invoices: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Both kinds of invoices with the user's name; what marketplace invoices lack is NULL.

    Without ``users`` both kinds have the columns of ``user_names`` already: a source that can join them to fewer rows than
    invoices moves the invoices once less.
    """
    own = ["invoice_type", "billing_period_start", "billing_period_end", "paid_at", "due_at"]
    names = [] if users is not None else ["user_id_ref", "full_name"]
    base = [F.col("id").alias("invoice_id"), "user_id", F.col("status").alias("invoice_status"),
            F.col("total_usd").alias("amount_usd"), *names]
    everything = subscription_invoices.select(*base, *own).unionByName(
        marketplace_invoices.select(F.col("id").cast("string").alias("invoice_id"), *base[1:]), allowMissingColumns=True)
    if users is not None:
        everything = everything.join(user_names(users), F.col("user_id") == F.col("user_id_ref"))
    return everything.select(
        "invoice_id", "user_id", "full_name", "invoice_type", "invoice_status", "amount_usd", "billing_period_start",
        "billing_period_end", "paid_at", "due_at", "user_id_ref")
