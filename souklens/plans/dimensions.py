"""Descriptive attributes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from souklens.functions.texts import strip_quotes
from souklens.functions.times import (
    date_of_text, day_of, month_name, months_before, parse_iso, quarter_text, second_of, year_month)
from souklens.operators import baskets
from souklens.session import is_broadcastable


def time(users: DataFrame, subscriptions: DataFrame, invoices: DataFrame, orders: DataFrame) -> DataFrame:
    """The distinct days of user creation, subscription start, invoices and orders.

    Times are cut to days before the union, so each task sends one row per day.
    """
    def day(df: DataFrame, name: str) -> DataFrame:
        moment = date_of_text(F.col(name)) if df.schema[name].dataType.typeName() == "string" else F.col(name)
        return df.select(day_of(moment).alias("date_key"))

    sources = [day(users, "created_at"), day(subscriptions, "started_at"), day(invoices, "created_at"), day(orders, "created_at")]
    key = F.col("date_key")
    return reduce(DataFrame.union, sources).distinct().select(
        key, F.year(key).alias("year_no"), F.month(key).alias("month_no"), year_month(key).alias("year_month"),
        month_name(key).alias("month_name"), quarter_text(key).alias("quarter_no"))


def price_band(price: Column) -> Column:
    """Fixed limits: below 20, 60 and 120; a missing price falls in the last band."""
    return F.when(price < 20, "budget").when(price < 60, "mid_range").when(price < 120, "premium").otherwise("luxury")


def product(products: DataFrame) -> DataFrame:
    return products.select(
        "product_id", F.col("name").alias("product_name"), "slug", "product_type", "price_usd", "currency", "is_active",
        "seller_id", F.col("created_at").alias("product_created_at"), price_band(F.col("price_usd")).alias("price_band"))


def seller(profiles: DataFrame, now: Column) -> DataFrame:
    """Sellers with their tenure at ``now``: up to 6 months, up to 24 months, longer (or unknown)."""
    opened = F.col("opened")
    maturity = F.when(opened >= months_before(now, 6), "new").when(
        opened >= months_before(now, 24), "established").otherwise("veteran")
    return profiles.withColumn("opened", second_of(parse_iso(strip_quotes(F.col("created_at"))))).select(
        "user_id", "display_name", "legal_name", "payout_email", "country_code", opened.alias("created_at"), "is_verified",
        maturity.alias("seller_maturity"))


_AFFINITY_LABELS = ("product_type", "seller_id")


def product_affinity(items: DataFrame, products: DataFrame) -> DataFrame:
    """Co-purchased pairs of the lines, labelled as ``product_affinity_type`` does.

    Where the labels of the catalogue are below the broadcast threshold, as Catalyst sizes them, pairs of ids are counted
    and labelled in place. Otherwise labels are joined to the lines, of which there are fewer than pairs, and travel along.
    """
    if is_broadcastable(products.select("product_id", *_AFFINITY_LABELS)):
        return product_affinity_type(baskets.bought_with(items, products), products)
    pairs = baskets.bought_with(items, products, labels=_AFFINITY_LABELS)
    return _affinity_categories(pairs.withColumnsRenamed({f"product_{i}_product_type": f"product_{i}_type" for i in (1, 2)}))


def product_affinity_type(pairs: DataFrame, products: DataFrame) -> DataFrame:
    """Stored pairs labelled by whether both products share their type and their seller; unknown is "cross"."""
    out = pairs.select("product_1_id", "product_2_id", "co_purchase_count")
    for side in (1, 2):
        p = products.select(F.col("product_id").alias(f"_p{side}"), F.col("product_type").alias(f"product_{side}_type"),
                            F.col("seller_id").alias(f"product_{side}_seller_id"))
        out = out.join(p, F.col(f"product_{side}_id") == F.col(f"_p{side}"), "left")
    return _affinity_categories(out)


def _affinity_categories(pairs: DataFrame) -> DataFrame:
    same_type = F.col("product_1_type") == F.col("product_2_type")
    same_seller = F.col("product_1_seller_id") == F.col("product_2_seller_id")
    return pairs.select(
        "product_1_id", "product_2_id", "co_purchase_count", "product_1_type", "product_2_type", "product_1_seller_id",
        "product_2_seller_id",
        F.when(same_type, "same_type").otherwise("cross_type").alias("affinity_type_category"),
        F.when(same_seller, "same_seller").otherwise("cross_seller").alias("affinity_seller_category"))


def geography(users: DataFrame, sellers: DataFrame, orders: DataFrame) -> DataFrame:
    """Users, sellers and orders per country; a country of orders is where they ship to.

    Each input is counted per country first, so the union holds a row per country and input.
    """
    measures = ("total_users", "total_sellers", "total_orders")

    def counted(df: DataFrame, country: str, measure: str) -> DataFrame:
        counts = df.groupBy(F.col(country).alias("country_code")).agg(F.count(F.lit(1)).alias(measure))
        return counts.select("country_code", *[F.col(m) if m == measure else F.lit(0).cast("long").alias(m) for m in measures])

    parts = [counted(users, "country_code", measures[0]), counted(sellers, "country_code", measures[1]),
             counted(orders, "shipping_country", measures[2])]
    return reduce(DataFrame.unionByName, parts).groupBy("country_code").agg(*[F.sum(m).alias(m) for m in measures])
