"""The domain tables, derived from the parquet tables of a data folder.

Each method returns a lazy frame. Small tables that a scan of a large one yields (plans, prices)
and the product catalogue are written once per session to the shared folder: they are read by
many reports, and a written table has an exact size, which decides whether it is broadcast.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from souklens.functions.times import iso_text, plus_days
from souklens.session import check_settings, forget, is_whole, outside_scopes, size_of, written_at

#: The reports' "now", fixed so that results can be compared.
AS_OF = dt.datetime(2001, 8, 1)

_tables: dict[tuple[str, str, str], DataFrame] = {}
_written: dict[tuple[str, str, str], tuple[DataFrame, str, int]] = {}


def _forget(app: str) -> None:
    for tables in (_tables, _written):
        for key in [k for k in tables if k[0].startswith(app + "/")]:
            del tables[key]


forget.append(_forget)


def as_of() -> Column:
    return F.lit(AS_OF.isoformat(sep=" ")).cast("timestamp")


def _day(text: str) -> Column:
    return F.lit(text + " 00:00:00").cast("timestamp")


def _money(amount: Column, precision: int = 12) -> Column:
    return amount.cast(f"decimal({precision},2)")


class Market:
    def __init__(self, spark: SparkSession, path: str):
        check_settings(spark)
        self.spark, self.path = spark, path.rstrip("/")

    def raw(self, table: str) -> DataFrame:
        """The lazy frame of a stored table; its files are listed and its schema read once."""
        key = self._key(table)
        if key not in _tables:
            _tables[key] = self.spark.read.parquet(f"{self.path}/{table}.parquet")
        return _tables[key]

    def _key(self, name: str) -> tuple[str, str, str]:
        session = self.spark._jsparkSession.sessionUUID()
        return f"{self.spark.sparkContext.applicationId}/{session}", self.path, name

    def once(self, name: str, build) -> DataFrame:
        """A table written the first time that a session asks for it, and read from then on. It is written anew
        if its folder or any of its files is gone, as when the shared folder is emptied between two queries of a session."""
        key = self._key(name)
        if key not in _written or not is_whole(self.spark, *_written[key][1:]):
            with outside_scopes():
                df, path = written_at(build(), name)
            _written[key] = df, path, size_of(self.spark, path)
        return _written[key][0]

    # people ---------------------------------------------------------------------------------

    def users(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").join(self.raw("nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(
            key.alias("id"),
            F.concat("c_name", F.lit("@example.org")).alias("email"),
            F.col("c_name").alias("full_name"),
            F.when(key % 37 != 0, F.col("n_name")).alias("country_code"),
            F.col("c_mktsegment").alias("city"),
            plus_days(_day("1995-01-01"), key % 365).alias("created_at"),
            F.when(key % 5 != 0, plus_days(as_of(), -(key % 90))).alias("last_login_at"),
            (F.col("c_acctbal") > 0).alias("is_active"),
        )

    def sellers(self) -> DataFrame:
        """Seller profiles as the CSV file has them: text only, times as quoted ISO text."""
        key = F.col("s_suppkey")
        opened = plus_days(as_of(), -(key * 37 % 1500))
        quoted = F.concat(F.lit('"'), iso_text(opened), F.lit('"'))
        verified = F.when(F.col("s_acctbal") > 0, "True").otherwise("False")
        return self.raw("supplier").join(self.raw("nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(
            key.cast("string").alias("user_id"),
            F.col("s_name").alias("display_name"),
            F.concat("s_name", F.lit(", Ltd")).alias("legal_name"),
            F.concat(F.lit("T"), key.cast("string")).alias("tax_id"),
            F.concat(F.lower("s_name"), F.lit("@pay.example.org")).alias("payout_email"),
            F.col("n_name").alias("country_code"),
            verified.alias("is_verified"),
            F.when(key % 4 != 0, F.concat(F.lit('Sells "goods", since '), F.year(opened).cast("string"))).alias("bio"),
            quoted.alias("created_at"),
            quoted.alias("updated_at"),
        )

    # catalogue ------------------------------------------------------------------------------

    def products(self) -> DataFrame:
        return self.once("products", self._products)

    def _products(self) -> DataFrame:
        seller = self.raw("lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("seller"))
        key = F.col("p_partkey")
        price = (_money(F.col("p_retailprice")) - 900) * F.lit(1.5).cast("decimal(3,1)")
        created = plus_days(_day("1994-01-01"), key % 700)
        return self.raw("part").join(seller, key == F.col("l_partkey"), "left").select(
            key.alias("product_id"),
            F.col("seller").cast("string").alias("seller_id"),
            F.col("p_name").alias("name"),
            F.concat(F.regexp_replace("p_name", " ", "-"), F.lit("-"), key.cast("string")).alias("slug"),
            F.col("p_type").alias("product_type"),
            F.col("p_brand").alias("description"),
            _money(price, 10).alias("price_usd"),
            F.lit("USD").alias("currency"),
            (F.col("p_size") > 5).alias("is_active"),
            created.alias("created_at"),
            plus_days(created, 30).alias("updated_at"),
        )

    # orders ---------------------------------------------------------------------------------

    def orders(self) -> DataFrame:
        """Orders as the relational store delivers them: the time is ISO text."""
        return self.orders_typed().withColumn("created_at", iso_text(F.col("created_at")))

    def order_headers(self) -> DataFrame:
        """Orders with a typed time and without the shipping country, which only a join yields."""
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("invoice_id"),
            F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at"))

    def orders_typed(self) -> DataFrame:
        nation = self.raw("customer").join(self.raw("nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(
            F.col("c_custkey"), F.col("n_name"))
        return self.order_headers().join(nation, F.col("c_custkey") == F.col("user_id")).select(
            "id", "user_id", "invoice_id", "status", F.col("n_name").alias("shipping_country"), "created_at")

    def _lines(self) -> list[Column]:
        total = _money(F.col("l_extendedprice"))
        each = F.round(total / F.col("l_quantity").cast("decimal(6,0)"), 2)
        return [
            F.col("l_quantity").cast("int").alias("quantity"),
            _money(each, 10).alias("unit_price_usd"),
            total.alias("line_total_usd"),
        ]

    @staticmethod
    def _line_id() -> Column:
        keys = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
        return F.concat_ws("-", *keys, F.date_format("l_shipdate", "yyyyMMdd"))

    def order_items(self) -> DataFrame:
        return self.raw("lineitem").select(
            self._line_id().alias("id"), F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
            *self._lines(),
        )

    def marketplace_invoices(self) -> DataFrame:
        """Orders in progress (status P) have no invoice yet."""
        status = F.when(F.col("o_orderstatus") == "F", "paid").otherwise("pending")
        return self.raw("orders").filter(F.col("o_orderstatus") != "P").select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), status.alias("status"),
            _money(F.col("o_totalprice")).alias("total_usd"),
            iso_text(F.col("o_orderdate").cast("timestamp")).alias("created_at"),
        )

    def marketplace_invoice_lines(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.concat(self._line_id(), F.lit("-M")).alias("id"), F.col("l_orderkey").alias("invoice_id"),
            F.col("l_partkey").alias("product_id"), *self._lines(),
        )

    # behaviour ------------------------------------------------------------------------------

    def events(self) -> DataFrame:
        """Events with a typed time, as the partitioned store holds them."""
        parts = self.raw("part").agg(F.expr("count(*) div 100").alias("n")).scalar()
        clicked = F.get_json_object("props", "$.k").cast("int")
        kind = F.expr("""
            CASE event_type
                WHEN 'view' THEN if(event_id % 2 = 0, 'page_view', 'product_view')
                WHEN 'click' THEN if(event_id % 2 = 0, 'search', 'add_to_cart')
                WHEN 'signup' THEN 'checkout_start'
                ELSE event_type
            END""")
        back = F.make_ym_interval(F.lit(0), (F.lit(270) + F.col("event_id") % 79).cast("int"))
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            F.col("user_id"),
            kind.alias("event_type"),
            F.when(clicked < 90, clicked * parts).cast("long").alias("product_id"),
            F.concat_ws("-", F.lit("s"), F.col("user_id").cast("string"), (F.col("event_id") % 7).cast("string")).alias("session_id"),
            F.col("props").alias("metadata"),
            (F.col("ts").cast("timestamp") - back).alias("occurred_at"),
        )

    def events_text(self) -> DataFrame:
        """Events as the remote store delivers them: the time is ISO text."""
        events = self.events()
        return events.select(
            "id", "user_id", "event_type", "product_id", "metadata",
            iso_text(F.col("occurred_at"), micros=True).alias("occurred_at"),
        )

    # subscriptions --------------------------------------------------------------------------

    def tiers(self) -> DataFrame:
        return self.once("tiers", lambda: self.raw("orders").select(F.col("o_orderpriority").alias("id")).distinct().select(
            "id", F.col("id").alias("name"), F.concat(F.lit("Plan "), F.col("id")).alias("description")))

    def tier_pricing(self) -> DataFrame:
        return self.once("tier_pricing", self._tier_pricing)

    def _tier_pricing(self) -> DataFrame:
        rank = F.substring("id", 1, 1).cast("int")
        base = (rank * 10).cast("decimal(10,2)")
        change = _day("1998-07-01")
        never = F.lit(None).cast("timestamp")
        first = F.struct(F.lit(1).alias("no"), (base - F.lit(0.01).cast("decimal(3,2)")).cast("decimal(10,2)").alias("price"),
                         _day("1995-01-01").alias("valid_from"), change.alias("valid_to"))
        second = F.struct(F.lit(2).alias("no"), (base + F.lit(2)).cast("decimal(10,2)").alias("price"),
                          change.alias("valid_from"), never.alias("valid_to"))
        periods = F.when(F.col("id") == "5-LOW", F.array(first)).otherwise(F.array(first, second))
        return self.tiers().select(F.col("id").alias("tier_id"), F.explode(periods).alias("p")).select(
            F.concat_ws("-", F.col("tier_id"), F.col("p.no").cast("string")).alias("id"),
            "tier_id",
            F.col("p.price").alias("monthly_price_usd"),
            "p.valid_from", "p.valid_to",
            F.col("p.valid_to").isNull().alias("is_active"),
        )

    def subscriptions(self) -> DataFrame:
        key = F.col("o_orderkey")
        start = F.col("o_orderdate").cast("timestamp")
        annual = F.col("o_orderstatus") == "F"
        end = F.when(key % 17 != 0, plus_days(start, F.when(annual, 365).otherwise(30)))
        cancelled = F.when(key % 3 == 0, plus_days(start, key % 200))
        return self.raw("orders").select(
            key.alias("id"),
            F.col("o_custkey").alias("user_id"),
            F.col("o_orderpriority").alias("tier_id"),
            F.when(key % 3 == 0, "cancelled").otherwise("active").alias("status"),
            start.alias("started_at"),
            start.alias("current_period_start"),
            end.alias("current_period_end"),
            cancelled.alias("cancelled_at"),
            F.when(key % 3 == 0, F.concat(F.lit("reason-"), (key % 4).cast("string"))).alias("cancel_reason"),
            F.when(annual, "annual").otherwise("monthly").alias("billing_cycle"),
            start.alias("created_at"),
            F.coalesce(cancelled, start).alias("updated_at"),
        )

    def subscription_invoices(self, names: DataFrame | None = None) -> DataFrame:
        """With ``names`` (``user_id_ref`` and more), the invoices of these users and these columns. They are joined to the
        orders, of which there are fewer than lines, and amounts are worked out before the join: lines are moved once, and narrow."""
        owner = self.raw("orders").select("o_orderkey", "o_custkey")
        if names is not None:
            owner = owner.join(names, F.col("o_custkey") == F.col("user_id_ref"))
        shipped = F.col("l_shipdate").cast("timestamp")
        subtotal = _money(F.col("l_extendedprice"))
        discount = _money(F.round(subtotal * F.col("l_discount").cast("decimal(4,2)"), 2))
        tax = _money(F.round(subtotal * F.col("l_tax").cast("decimal(4,2)"), 2))
        amounts = [subtotal.alias("subtotal_usd"), tax.alias("tax_usd"), discount.alias("discount_usd"), _money(subtotal - discount).alias("total_usd")]
        lines = self.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate", *amounts)
        paid = F.col("l_returnflag") == "N"
        return lines.join(owner, F.col("l_orderkey") == F.col("o_orderkey")).select(
            self._line_id().alias("id"),
            F.col("o_custkey").alias("user_id"),
            F.col("l_orderkey").alias("subscription_id"),
            F.lit("subscription").alias("invoice_type"),
            F.when(paid, "paid").when(F.col("l_returnflag") == "R", "overdue").otherwise("pending").alias("status"),
            "subtotal_usd", "tax_usd", "discount_usd", "total_usd",
            shipped.alias("billing_period_start"),
            plus_days(shipped, 30).alias("billing_period_end"),
            F.when(paid, plus_days(shipped, F.col("l_partkey") % 30)).alias("paid_at"),
            plus_days(shipped, 14).alias("due_at"),
            shipped.alias("created_at"),
            *(names.columns if names is not None else []),
        )

    def subscription_invoice_lines(self) -> DataFrame:
        """One line per invoice; a seventh position has no line."""
        return self.raw("lineitem").filter(F.col("l_linenumber") != 7).select(
            F.concat(self._line_id(), F.lit("-L1")).alias("id"),
            self._line_id().alias("invoice_id"),
            F.col("l_partkey").alias("product_id"),
            F.concat(F.lit("Item "), F.col("l_linenumber").cast("string")).alias("description"),
            *self._lines(),
            F.col("l_shipdate").cast("timestamp").alias("created_at"),
        )
