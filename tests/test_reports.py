from __future__ import annotations

import datetime as dt
from collections import Counter

from pyspark.sql import functions as F

from souklens.plans import consolidation, dimensions, facts, reports
from souklens.plans.catalog import Published
from souklens.sources.market import Market, as_of
from souklens.workload import datasets
from souklens.workload.published import CATALOG

T = "timestamp"


def users(spark, rows):
    return spark.createDataFrame(rows, "id int, country_code string").withColumns({
        "email": F.lit("e"), "full_name": F.lit("n"), "city": F.lit("c"), "created_at": F.lit("2020-01-01").cast(T),
        "last_login_at": F.lit(None).cast(T), "is_active": F.lit(True)})


def test_unknown_country_is_not_taken_for_a_month_total(spark):
    u = users(spark, [(1, "RO"), (2, None)])
    events = spark.createDataFrame([(1, 1, "search", None, "{}", "2024-01-05T00:00:00Z"), (2, 2, "search", None, "{}", "2024-01-06T00:00:00Z"),
                                    (3, 2, "purchase", None, "{}", "2024-02-06T00:00:00Z")],
                                   "id int, user_id int, event_type string, product_id int, metadata string, occurred_at string")
    orders = spark.createDataFrame([(10, 1, "2024-01-07T00:00:00Z"), (11, 2, "2024-01-09T00:00:00Z"), (12, 2, "2024-02-09T00:00:00Z"),
                                    (13, 1, "2024-03-09T00:00:00Z")], "id int, user_id int, created_at string")
    items = spark.createDataFrame([(10, 2, "5.00"), (11, 1, "7.00"), (11, None, "1.00"), (12, 1, "20.00"), (13, 1, "99.00")],
                                  "order_id int, quantity int, line string").withColumn("line_total_usd", F.col("line").cast("decimal(12,2)"))
    rows = reports.engagement_revenue_monthly(u, events, orders, items).collect()
    assert len(rows) == 3 + 2 + 1  # month and country, month, all
    january, february = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    total = {(r.activity_month, r.grp_month): r for r in rows if r.grp_country == 1}
    assert (total[january, 0].total_revenue_usd, total[january, 0].cumulative_revenue_usd, total[january, 0].prev_month_revenue_usd) == (13, 13, None)
    assert (total[february, 0].total_revenue_usd, total[february, 0].cumulative_revenue_usd, total[february, 0].prev_month_revenue_usd) == (20, 33, 13)
    assert total[None, 1].total_revenue_usd == 33 and total[None, 1].cumulative_revenue_usd is None  # March has sales but no activity
    detail = {(r.activity_month, r.country_code): r for r in rows if r.grp_country == 0}
    assert detail[january, None].total_orders == 1 and detail[january, None].cumulative_orders == 2


def test_geo_density_totals_and_ties(spark):
    geo = spark.createDataFrame([("A", 10, 2, 100), ("B", 10, 0, 50), ("C", 20, 1, 50), ("D", 60, 4, 1), (None, 5, 5, 5)],
                                "country_code string, total_users long, total_sellers long, total_orders long")
    rows = reports.geo_density(geo).collect()
    detail = {r.country_code: r for r in rows if r.grouping_label == "Country Detail"}
    assert set(detail) == {"A", "B", "C", "D"}
    assert detail["B"].country_rank == detail["C"].country_rank == 2 and detail["D"].country_rank == 4
    assert sum(r.user_share_pct for r in detail.values()) == 100
    assert detail["B"].buyer_seller_ratio is None and detail["A"].buyer_seller_ratio == 5
    grand = [r for r in rows if r.grouping_label == "Grand Total"]
    assert len(grand) == 1 and grand[0].total_orders == 201 and grand[0].country_rank is None


def test_retention_and_days_active_edges(spark):
    u = users(spark, [(1, "RO")])
    rows = [(1, "2024-01-01", "2024-01-31", None), (2, "2024-01-01 12:00:00", None, "2024-01-02"), (3, "2001-07-01", None, None),
            (4, "2024-01-01", "2024-03-31", "2024-01-30")]
    subs = spark.createDataFrame(rows, "id int, a string, b string, c string").select(
        "id", F.lit(1).alias("user_id"), F.lit("x").alias("status"), F.col("a").cast(T).alias("started_at"), F.col("a").cast(T).alias("current_period_start"),
        F.col("b").cast(T).alias("current_period_end"), F.col("c").cast(T).alias("cancelled_at"), F.lit(None).cast("string").alias("cancel_reason"),
        F.lit("monthly").alias("billing_cycle"), F.col("a").cast(T).alias("created_at"), F.col("a").cast(T).alias("updated_at"), F.lit("t").alias("tier_id"))
    tiers = spark.createDataFrame([("t", "Tier", "d")], "id string, name string, description string")
    pricing = spark.createDataFrame([], "id string, tier_id string, monthly_price_usd decimal(10,2), valid_from timestamp, valid_to timestamp, is_active boolean")
    found = {r.subscription_id: r for r in facts.sub_cohort(facts.user_subscription(u, subs, tiers, pricing), as_of()).collect()}
    assert (found[1].days_active, found[1].retained_30d, found[1].retained_90d, found[1].churned_flag) == (30.0, 1, 0, 0)
    assert (found[2].days_active, found[2].retained_30d, found[2].churned_flag) == (0.5, 0, 1)
    assert (found[3].days_active, found[3].retained_30d) == (31.0, 0)  # open: counted to now, not as retained
    assert (found[4].days_active, found[4].retained_30d) == (29.0, 0)  # the cancellation counts, not the period end


def test_retention_cohort_over_a_month_gap(spark):
    cohort = spark.createDataFrame([("t", "2024-01-01", 1), ("t", "2024-01-01", 0), ("t", "2024-02-01", 0), ("t", "2024-05-01", 1)],
                                   "tier_name string, m string, churned_flag int").withColumn("cohort_month", F.col("m").cast(T))
    rows = reports.sub_retention_cohort(cohort).orderBy("cohort_month").collect()
    assert [r.cumulative_churned for r in rows] == [1, 1, 2]
    assert [r.survival_rate_pct for r in rows] == [50.0, 0.0, -100.0]  # churn of all months against one month's size
    assert [r.rolling_3m_churn_rate for r in rows] == [50.0, 25.0, 50.0]
    assert [r.next_month_churn_proj for r in rows] == [0.0, 100.0, None]


def test_payment_behaviour_guards(spark):
    u = users(spark, [(1, "RO"), (2, None)])
    subs = spark.createDataFrame([(1, "t", "monthly"), (2, "t", "annual")], "id int, tier_id string, billing_cycle string")
    tiers = spark.createDataFrame([("t", "Tier")], "id string, name string")
    rows = [("a", 1, 1, "paid", 100.0, 10.0, "2024-01-15", "2024-01-10"), ("b", 1, 1, "paid", 100.0, 10.0, "2024-01-15", "2024-01-15"),
            ("c", 2, 2, "pending", 0.0, 0.0, "2024-01-15", None)]
    invoices = spark.createDataFrame(rows, "id string, user_id int, subscription_id int, status string, sub double, disc double, due string, paid string").select(
        "id", "user_id", "subscription_id", "status", F.col("sub").cast("decimal(12,2)").alias("subtotal_usd"), F.col("disc").cast("decimal(12,2)").alias("discount_usd"),
        F.col("sub").cast("decimal(12,2)").alias("total_usd"), F.col("due").cast(T).alias("due_at"), F.col("paid").cast(T).alias("paid_at"))
    found = reports.invoice_payment_behaviour(invoices, subs, tiers, u).collect()
    assert Counter((r.grp_tier, r.grp_cycle, r.grp_country) for r in found) == Counter(
        {(0, 0, 0): 2, (0, 0, 1): 2, (0, 1, 0): 2, (0, 1, 1): 1, (1, 0, 0): 2, (1, 0, 1): 2, (1, 1, 0): 2, (1, 1, 1): 1})
    by = {(r.grp_tier, r.grp_cycle, r.grp_country, r.country_code): r for r in found}
    lone = by[0, 0, 0, None]  # one unpaid invoice of a user without country
    assert (lone.stddev_invoice_usd, lone.stddev_days_to_pay, lone.median_days_to_pay, lone.avg_discount_rate_pct) == (0.0, None, None, None)
    same = by[0, 0, 0, "RO"]  # two equal paid invoices
    assert (same.stddev_invoice_usd, same.discount_payment_correlation, same.invoice_size_payment_speed_corr) == (0.0, None, None)
    assert (same.median_days_to_pay, same.stddev_days_to_pay, same.median_invoice_usd) == (-2.5, 3.54, 100.0)
    grand = by[1, 1, 1, None]
    assert (grand.total_invoices, grand.paid_count, grand.payment_rate_pct, grand.grouping_label) == (3, 2, 66.67, "Grand Total")


def test_affinity_categories_of_unknown_products(spark):
    pairs = spark.createDataFrame([(1, 2, 5), (1, 3, 1), (3, 9, 1)], "product_1_id int, product_2_id int, co_purchase_count long")
    products = spark.createDataFrame([(1, "a", "s1"), (2, "a", "s1"), (3, "a", "s2")], "product_id int, product_type string, seller_id string")
    found = {(r.product_1_id, r.product_2_id): (r.affinity_type_category, r.affinity_seller_category)
             for r in dimensions.product_affinity_type(pairs, products).collect()}
    assert found == {(1, 2): ("same_type", "same_seller"), (1, 3): ("same_type", "cross_seller"), (3, 9): ("cross_type", "cross_seller")}


def test_seller_maturity_limits(spark):
    rows = [("a", '"2001-02-01T00:00:00+00:00"'), ("b", '"2001-01-31T23:59:59+00:00"'), ("c", '"1999-08-01T00:00:00Z"'), ("d", '"1999-07-31T23:59:59Z"'), ("e", "never")]
    profiles = spark.createDataFrame(rows, "user_id string, created_at string").withColumns(
        {c: F.lit("x") for c in ("display_name", "legal_name", "payout_email", "country_code", "is_verified")})
    found = {r.user_id: r.seller_maturity for r in dimensions.seller(profiles, as_of()).collect()}
    assert found == {"a": "new", "b": "established", "c": "established", "d": "veteran", "e": "veteran"}


def test_price_bands(spark):
    df = spark.createDataFrame([("19.99",), ("20.00",), ("59.99",), ("60.00",), ("120.00",), (None,)], "p string")
    assert [r.b for r in df.select(dimensions.price_band(F.col("p").cast("decimal(10,2)")).alias("b")).collect()] == [
        "budget", "mid_range", "mid_range", "premium", "luxury", "luxury"]


def test_sales_per_order_equal_the_row_level_view(spark):
    """The shortcuts of the monthly facts (sums per order, no invoice join) change no number."""
    m = Market(spark, "/root/testdata/sf0.001")
    rows = facts.user_orders(m.users(), m.orders(), m.order_items(), m.marketplace_invoices())
    direct = rows.groupBy(F.col("id").alias("user_id"), F.date_trunc("MM", F.substring("order_created_at", 1, 10)).alias("order_month")).agg(
        F.countDistinct("order_id").alias("n"), F.sum("quantity").alias("q"), F.sum("line_total_usd").cast("double").alias("r"))
    short = facts.sales_by_user_month(m.orders(), m.order_items()).select("user_id", "order_month", "order_count", "total_quantity", F.col("total_revenue_usd").cast("double"))
    assert Counter(map(tuple, direct.collect())) == Counter(map(tuple, short.collect()))


def test_running_totals_end_in_the_total(spark):
    m = Market(spark, "/root/testdata/sf0.001")
    rows = reports.product_affinity_analytics(datasets.affinity_type(m))
    last = rows.filter("grouping_label = 'Pair Detail'").groupBy("affinity_seller_category").agg(F.max("running_co_purchases").alias("v"))
    total = rows.filter("grouping_label = 'Seller Category Subtotal'").select("affinity_seller_category", F.col("total_co_purchases").alias("v"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, total.collect()))


def test_invoice_union_fills_missing_columns(spark):
    m = Market(spark, "/root/testdata/sf0.001")
    rows = consolidation.invoices(m.subscription_invoices(), m.marketplace_invoices(), m.users())
    market = rows.filter("invoice_type IS NULL")
    assert market.filter("billing_period_start IS NOT NULL OR due_at IS NOT NULL").count() == 0
    assert rows.count() == m.subscription_invoices().count() + m.marketplace_invoices().count()


def test_published_order_and_pages(spark, tmp_path):
    assert len(CATALOG) == 14
    m = Market(spark, "/root/testdata/sf0.001")
    trend = CATALOG["billing-trend"]
    trend.write(m, str(tmp_path / "trend"))
    assert spark.read.parquet(str(tmp_path / "trend")).count() == trend.frame(m).count()
    rows = trend.frame(m).collect()
    assert [r.tier_name for r in rows] == sorted(r.tier_name for r in rows)
    numbers = Published(lambda s: spark.range(25).select("id", (F.col("id") % 2).alias("k")), (("k", "desc"),))
    assert [r.id for n in range(3) for r in numbers.page(None, n, 10).collect()] == [*range(1, 25, 2), *range(0, 25, 2)]
