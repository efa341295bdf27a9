"""The eight analytic reports and the cohort roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from souklens.functions.numbers import exact, flag, mean_amount, nvl, percent, percent_raw, ratio
from souklens.functions.times import month_in, month_of, seconds_between, second_of
from souklens.operators.joins import latest_per_key, null_safe, valid_at
from souklens.operators.moments import cell_comoments, cell_moments, centred, merged_pearson, merged_stddev
from souklens.operators.quantiles import exact_quantiles
from souklens.operators.rankings import rank_and_running_total
from souklens.plans.facts import EVENT_COUNTERS, activity_by_user_month, sales_by_user_month
from souklens.session import written

_TO_HERE = (Window.unboundedPreceding, Window.currentRow)

#: Report column -> counter of the user-month fact. Fixed values.
_ENGAGEMENT = {
    "total_events": "total_events",
    "total_page_views": "page_views",
    "total_product_views": "product_views",
    "total_searches": "searches",
    "total_add_to_cart": "add_to_cart_events",
    "total_checkout_starts": "checkout_starts",
    "total_purchase_events": "purchase_events",
}
_SALES = ("total_orders", "total_quantity", "total_revenue_usd")


def engagement_revenue_monthly(users: DataFrame, events: DataFrame, orders: DataFrame, items: DataFrame) -> DataFrame:
    """Activity and sales by month and country with month and grand totals, and on each row of a
    month the running revenue and orders and the previous month's revenue.

    Both inputs are reduced to user and month before the user's country is joined, then to month
    and country. Everything after that has at most one row per month and country.
    """
    country = users.select(F.col("id").alias("_id"), "country_code")
    activity = activity_by_user_month(events).join(country, F.col("user_id") == F.col("_id")).groupBy(
        "activity_month", "country_code").agg(*[F.sum(c).alias(a) for a, c in _ENGAGEMENT.items()])
    sales = sales_by_user_month(orders, items).withColumnRenamed("total_quantity", "_q").withColumnRenamed(
        "total_revenue_usd", "_r").join(country, F.col("user_id") == F.col("_id")).groupBy(
        "order_month", F.col("country_code").alias("order_country")).agg(
        F.sum("order_count").alias("total_orders"), F.sum("_q").alias("total_quantity"), F.sum("_r").alias("total_revenue_usd"))

    # A month is compared with =, a country with NULL-safe equality.
    same = (F.col("activity_month") == F.col("order_month")) & null_safe([(F.col("country_code"), F.col("order_country"))])
    combined = activity.join(sales, same, "left")
    zero = {"total_orders": F.lit(0), "total_quantity": F.lit(0), "total_revenue_usd": F.lit(0).cast("decimal(32,2)")}
    rolled = combined.rollup("activity_month", "country_code").agg(
        *[F.sum(a).alias(a) for a in _ENGAGEMENT],
        *[F.sum(F.coalesce(F.col(s), zero[s])).alias(s) for s in _SALES],
        F.grouping("activity_month").cast("int").alias("grp_month"),
        F.grouping("country_code").cast("int").alias("grp_country"))

    # Month totals are told from rows of an unknown country by the flag, not by the NULL.
    is_total = (F.col("grp_month") == 0) & (F.col("grp_country") == 1) & F.col("activity_month").isNotNull()
    by_month = Window.partitionBy("_total").orderBy("activity_month")
    spread = Window.partitionBy("grp_month", "activity_month")
    running = {
        "cumulative_revenue_usd": F.sum("total_revenue_usd").over(by_month.rowsBetween(*_TO_HERE)),
        "cumulative_orders": F.sum("total_orders").over(by_month.rowsBetween(*_TO_HERE)),
        "prev_month_revenue_usd": F.lag("total_revenue_usd").over(by_month),
    }
    out = rolled.withColumn("_total", is_total)
    out = out.select("*", *[F.when(F.col("_total"), c).alias(f"_{name}") for name, c in running.items()])
    return out.select(
        "activity_month", "country_code", *_ENGAGEMENT, *_SALES,
        *[F.max(f"_{name}").over(spread).alias(name) for name in running], "grp_month", "grp_country")


def geo_density(geography: DataFrame) -> DataFrame:
    """Countries banded by order volume, with band and grand totals; quartile, rank and share of
    users on the country rows. There is one input row per country."""
    orders = F.col("total_orders")
    everywhere = Window.partitionBy()
    high, mid = (F.percentile("total_orders", F.lit(p)).over(everywhere) for p in (0.66, 0.33))
    banded = geography.filter(F.col("country_code").isNotNull()).withColumn(
        "activity_band", F.when(orders >= high, "High").when(orders >= mid, "Mid").otherwise("Low"))
    rolled = banded.rollup("activity_band", "country_code").agg(
        F.sum("total_users").alias("total_users"), F.sum("total_sellers").alias("total_sellers"),
        F.sum("total_orders").alias("total_orders"), F.grouping("activity_band").alias("_all"),
        F.grouping("country_code").alias("_sub"))

    # Totals form a window partition of their own and show none of the window columns.
    peers = Window.partitionBy("_sub")
    by_orders = peers.orderBy(F.desc("total_orders"))
    detail = F.col("_sub") == 0
    share = percent(F.col("total_users"), F.sum("total_users").over(peers))
    label = F.when(F.col("_all") == 1, "Grand Total").when(F.col("_sub") == 1, "Activity Band Subtotal").otherwise("Country Detail")
    return rolled.select(
        F.when(F.col("_all") == 1, "** ALL BANDS **").otherwise(F.col("activity_band")).alias("activity_band"),
        "country_code", "total_users", "total_sellers", "total_orders",
        ratio(F.col("total_users"), F.col("total_sellers")).alias("buyer_seller_ratio"),
        F.when(detail, share).alias("user_share_pct"),
        F.when(detail, F.ntile(4).over(peers.orderBy(F.desc("total_orders"), "country_code"))).alias("order_volume_quartile"),
        F.when(detail, F.rank().over(by_orders)).alias("country_rank"),
        label.alias("grouping_label"))


def product_affinity_analytics(affinity: DataFrame) -> DataFrame:
    """Pairs with rank, running total and comparison to the global mean, and totals per type
    category and per seller category.

    The pairs are written once, when the frame is built, since the histogram, the totals and the detail
    rows all read them; ``session.scope`` deletes them after use.
    """
    keys = ["affinity_type_category", "affinity_seller_category"]
    pair = [*keys, "product_1_id", "product_2_id"]
    known = affinity.filter(F.col("product_1_id").isNotNull() & F.col("product_2_id").isNotNull())
    pairs = written(known.groupBy(*pair, "product_1_type", "product_2_type").agg(
        F.count(F.lit(1)).alias("pair_count"), F.sum("co_purchase_count").alias("total_co_purchases")).drop(
        "product_1_type", "product_2_type"), "affinity_pairs")

    by_both = pairs.groupBy(*keys).agg(F.sum("pair_count").alias("pair_count"), F.sum("total_co_purchases").alias("total_co_purchases"))
    overall = by_both.agg(F.struct(F.sum("pair_count").alias("n"), F.sum("total_co_purchases").alias("s"))).scalar()

    ranked = rank_and_running_total(
        pairs, rank_by=keys[0], total_by=keys[1], value="total_co_purchases", ids=["product_1_id", "product_2_id"],
        rank_as="rank_in_type_category", running_as="running_co_purchases")
    # mean >= global mean, compared as products of whole numbers
    mine = exact(F.col("total_co_purchases")) * exact(overall["n"])
    theirs = exact(overall["s"]) * exact(F.col("pair_count"))
    detail = ranked.select(
        *pair, "pair_count", "total_co_purchases", "rank_in_type_category", "running_co_purchases",
        F.when(mine >= theirs, "above_avg").otherwise("below_avg").alias("vs_global_avg_flag"),
        F.lit("Pair Detail").alias("grouping_label"))

    totals = by_both.groupingSets([[keys[0]], [keys[1]]], *keys).agg(
        F.sum("pair_count").alias("pair_count"), F.sum("total_co_purchases").alias("total_co_purchases"),
        F.grouping(keys[0]).alias("_no_type"), F.grouping(keys[1]).alias("_no_seller"))
    totals = totals.select(
        F.when(F.col("_no_type") == 1, "** ALL **").otherwise(F.col(keys[0])).alias(keys[0]),
        F.when(F.col("_no_seller") == 1, "** ALL **").otherwise(F.col(keys[1])).alias(keys[1]),
        "pair_count", "total_co_purchases", F.lit("subtotal").alias("vs_global_avg_flag"),
        F.when(F.col("_no_seller") == 1, "Type Category Subtotal").otherwise("Seller Category Subtotal").alias("grouping_label"))
    return detail.unionByName(totals, allowMissingColumns=True).select(
        *pair, "pair_count", "total_co_purchases",
        ratio(F.col("total_co_purchases"), F.col("pair_count")).alias("avg_co_purchases"),
        "rank_in_type_category", "running_co_purchases", "vs_global_avg_flag", "grouping_label")


def sub_retention_cohort(cohort: DataFrame) -> DataFrame:
    """Size and churn per plan and start month with cumulative churn, survival, three-row rolling
    churn and the next month's churn. Survival sets the month's size against the churn of all
    months so far, as the source model does, and can be negative."""
    monthly = cohort.groupBy("tier_name", "cohort_month").agg(
        F.count(F.lit(1)).alias("cohort_size"), F.sum("churned_flag").alias("churned_this_month"))
    by_tier = Window.partitionBy("tier_name").orderBy("cohort_month")
    size, churned = F.col("cohort_size"), F.col("churned_this_month")
    recent = by_tier.rowsBetween(-2, Window.currentRow)
    raw = percent_raw(churned, size)
    rolling = F.sum(raw).over(recent) / F.count(raw).over(recent)
    out = monthly.select(
        "*", F.sum(churned).over(by_tier.rowsBetween(*_TO_HERE)).alias("cumulative_churned"),
        percent(churned, size).alias("churn_rate_pct"),
        F.round(rolling, 2).cast("double").alias("rolling_3m_churn_rate"),
        F.lead(percent(churned, size), 1).over(by_tier).alias("next_month_churn_proj"))
    survived = percent(size - F.col("cumulative_churned"), size)
    return out.select("tier_name", "cohort_month", "cohort_size", "churned_this_month", "cumulative_churned",
                      survived.alias("survival_rate_pct"), "churn_rate_pct", "rolling_3m_churn_rate", "next_month_churn_proj")


def subscription_billing_trend(invoices: DataFrame, subscriptions: DataFrame, tiers: DataFrame, by_cycle: bool = False) -> DataFrame:
    """Paid invoices by month, plan and billing cycle with running, earlier, later, first and last
    revenue of the plan. The rows of a plan are ordered by month, then cycle; "previous" may thus
    be the same month's other cycle. ``by_cycle`` looks within the cycle instead.

    Invoices are reduced to one row per user, month, plan and cycle first; those rows count the
    distinct users, so no row is duplicated for a distinct count.
    """
    s = subscriptions.select(F.col("id").alias("_sub"), "billing_cycle", F.col("tier_id").alias("_plan"))
    t = tiers.select(F.col("id").alias("_tier"), F.col("name").alias("tier_name"))
    plan = s.join(t, F.col("_plan") == F.col("_tier"))
    paid = invoices.filter(F.col("status") == "paid").join(plan, F.col("subscription_id") == F.col("_sub"))
    keys = ["billing_month", "tier_name", "billing_cycle"]
    sums = {"total_billed_usd": "total_usd", "total_discount_usd": "discount_usd", "total_tax_usd": "tax_usd"}
    per_user = paid.withColumn("billing_month", month_of(F.col("billing_period_start"))).groupBy(*keys, "user_id").agg(
        F.count("id").alias("_invoices"), *[F.sum(c).alias(f"_{c}") for c in sums.values()])
    monthly = per_user.groupBy(*keys).agg(
        F.sum("_invoices").alias("invoice_count"), *[F.sum(f"_{c}").alias(a) for a, c in sums.items()],
        F.count("user_id").alias("unique_users_billed"))

    of_tier = Window.partitionBy("tier_name", *(["billing_cycle"] if by_cycle else []))
    in_order = of_tier.orderBy("billing_month", "billing_cycle")
    to_here = in_order.rowsBetween(*_TO_HERE)
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    billed = "total_billed_usd"
    previous = F.lag(billed, 1).over(in_order)
    growth = F.lit(100) * (exact(F.col(billed), 20, 2) - exact(previous, 20, 2)) / F.nullif(exact(previous, 20, 2), F.lit(0))
    return monthly.select(
        *keys, "invoice_count", *sums, "unique_users_billed",
        F.sum(billed).over(to_here).alias("cumulative_revenue_usd"),
        previous.alias("prev_month_revenue_usd"),
        F.lag(billed, 12).over(in_order).alias("same_month_prior_year_usd"),
        F.lead(billed, 1).over(in_order).alias("next_month_revenue_usd"),
        F.first(billed).over(to_here).alias("first_month_revenue_usd"),
        F.last(billed).over(whole).alias("last_month_revenue_usd"),
        F.round(growth, 2).cast("double").alias("mom_growth_pct"))


def funnel_stage(event_type: Column) -> Column:
    """Fixed values."""
    return (F.when(event_type.isin("page_view", "search"), "awareness")
            .when(event_type.isin("product_view", "add_to_cart"), "consideration")
            .when(event_type.isin("checkout_start", "purchase"), "conversion")
            .otherwise("other"))


def _latest_plans(subscriptions: DataFrame) -> DataFrame:
    latest = latest_per_key(subscriptions, "user_id", "started_at", "id", ["tier_id"])
    return latest.select(F.col("user_id").alias("_subscriber"), F.col("tier_id").alias("_plan"))


def _plan_periods(subscriptions: DataFrame) -> DataFrame:
    """Plans of a user from one subscription's start to the next one's; of several that start together the
    one with the largest id. The subscriptions of a user are few."""
    starts = subscriptions.filter(F.col("started_at").isNotNull()).groupBy("user_id", "started_at").agg(F.max_by("tier_id", "id").alias("_plan"))
    following = F.lead("started_at").over(Window.partitionBy("user_id").orderBy("started_at"))
    return starts.select(F.col("user_id").alias("_subscriber"), "_plan", F.col("started_at").alias("_from"), following.alias("_to"))


def funnel_conversion_by_tier(
    users: DataFrame, events: DataFrame, products: DataFrame, subscriptions: DataFrame, tiers: DataFrame, at_event: bool = False,
) -> DataFrame:
    """Events, users and conversion rates by plan and funnel stage, also split by product type and
    by month, and over everything. A user's plan is that of the latest subscription; with ``at_event``
    the one that had started last when the event (with a typed time) occurred.

    Events are counted per user, type, product and month before any join, and once more per user,
    stage, product type and month before the rows are multiplied by the grouping sets. Only plans at
    event time need each event to meet its user's periods first; that join can be split on events.
    """
    plan_key = []
    if at_event:
        during = (F.col("user_id") == F.col("_subscriber")) & valid_at(F.col("_from"), F.col("_to"), F.col("occurred_at"))
        events, plan_key = events.join(_plan_periods(subscriptions), during, "left"), ["_plan"]
    counted = events.groupBy(
        F.col("user_id"), "event_type", "product_id", *plan_key, month_in(events, "occurred_at").alias("event_month")).agg(
        F.count(F.lit(1)).alias("n"))
    p = products.select(F.col("product_id").alias("_product"), "product_type")
    lower = F.col("event_type").isin("add_to_cart", "checkout_start", "purchase")
    per_user = counted.join(p, F.col("product_id") == F.col("_product"), "left").groupBy(
        "user_id", *plan_key, funnel_stage(F.col("event_type")).alias("funnel_stage"), "product_type", "event_month").agg(
        F.sum("n").alias("n"), F.sum(F.when(lower, F.col("n")).otherwise(0)).alias("converted"),
        F.sum(F.when(F.col("event_type") == "purchase", F.col("n")).otherwise(0)).alias("bought"))
    known = per_user.join(users.select(F.col("id").alias("_user")), F.col("user_id") == F.col("_user"))
    if not at_event:
        known = known.join(_latest_plans(subscriptions), F.col("user_id") == F.col("_subscriber"), "left")
    base = known.join(tiers.select(F.col("id").alias("_tier"), F.col("name").alias("tier_name")), F.col("_plan") == F.col("_tier"), "left")

    keys = ["tier_name", "funnel_stage", "product_type", "event_month"]
    sets = [keys[:2], keys[:3], ["tier_name", "funnel_stage", "event_month"], []]
    total, converted, bought = (F.sum(c) for c in ("n", "converted", "bought"))
    return base.groupingSets(sets, *keys).agg(
        total.alias("total_events"), converted.alias("conversion_events"), bought.alias("purchase_events"),
        F.countDistinct("user_id").alias("unique_users"),
        percent(bought, total).alias("purchase_rate_pct"), percent(converted, total).alias("conversion_rate_pct"),
        *[F.grouping(k).cast("int").alias(a) for k, a in zip(keys, ("grp_tier", "grp_funnel", "grp_product_type", "grp_month"))])


#: Values ranked together when a quantile is located: 1,000 currency units in cents, one day in seconds.
_CENTS_PER_BUCKET = 100_000
_SECONDS_PER_BUCKET = 86_400


def invoice_payment_behaviour(invoices: DataFrame, subscriptions: DataFrame, tiers: DataFrame, users: DataFrame) -> DataFrame:
    """Invoices by every combination of plan, billing cycle and country: counts, rates, mean,
    deviation, quantiles and correlations.

    The joined invoices are written once, when the frame is built, and read three times: for the moments of the finest cells,
    which are then merged up the cube, to locate the quantiles, and to pick them.
    """
    keys = ["tier_name", "billing_cycle", "country_code"]
    base = written(_invoice_base(invoices, subscriptions, tiers, users), "invoice_base")
    merged = _merged_cells(base, keys)
    quantiles = _cube_quantiles(base, keys)
    label = (F.when(F.col("_g") == 7, "Grand Total")
             .when((F.col("grp_cycle") == 1) & (F.col("grp_country") == 1), "Tier Subtotal")
             .when(F.col("grp_country") == 1, "Tier + Cycle Subtotal").otherwise("Detail"))
    same = null_safe([(F.col("_g"), F.col("_qg"))] + [(F.col(k), F.col(f"_q{k}")) for k in keys])
    return merged.join(quantiles, same, "left").select(
        *keys, "total_invoices", "paid_count", "overdue_count", "discounted_count", "payment_rate_pct", "overdue_rate_pct",
        "avg_invoice_usd", "median_invoice_usd", "stddev_invoice_usd", "p25_invoice_usd", "p75_invoice_usd",
        "avg_discount_rate_pct", "median_days_to_pay", "stddev_days_to_pay", "discount_payment_correlation",
        "invoice_size_payment_speed_corr", label.alias("grouping_label"), "grp_tier", "grp_cycle", "grp_country")


def _invoice_base(invoices: DataFrame, subscriptions: DataFrame, tiers: DataFrame, users: DataFrame) -> DataFrame:
    s = subscriptions.select(F.col("id").alias("_sub"), "billing_cycle", F.col("tier_id").alias("_plan"))
    t = tiers.select(F.col("id").alias("_tier"), F.col("name").alias("tier_name"))
    u = users.select(F.col("id").alias("_user"), "country_code")
    rate = F.round(exact(F.col("discount_usd"), 12, 2) * 100 / F.nullif(exact(F.col("subtotal_usd"), 12, 2), F.lit(0)), 2)
    return invoices.join(s.join(t, F.col("_plan") == F.col("_tier")), F.col("subscription_id") == F.col("_sub")).join(
        u, F.col("user_id") == F.col("_user")).select(
        "tier_name", "billing_cycle", "country_code", F.col("total_usd"), rate.cast("decimal(12,2)").alias("rate"),
        F.col("id").isNotNull().alias("has_id"),
        seconds_between(second_of(F.col("paid_at")), second_of(F.col("due_at"))).alias("pay_seconds"),
        flag(F.col("status") == "paid").alias("is_paid"), flag(F.col("status") == "overdue").alias("is_overdue"),
        flag(F.col("discount_usd") > 0).alias("has_discount"))


def _merged_cells(base: DataFrame, keys: list[str]) -> DataFrame:
    days = f"pay_seconds / {_SECONDS_PER_BUCKET}"
    sums = {"n": "count_if(has_id)", "paid": "sum(is_paid)", "overdue": "sum(is_overdue)", "discounted": "sum(has_discount)",
            "billed": "sum(total_usd)", "rates": "sum(rate)", "rated": "count(rate)"}
    cells = base.groupBy(*keys).agg(
        *[F.expr(f"{e} AS {name}") for name, e in sums.items()],
        *cell_moments("total", "total_usd"), *cell_moments("days", days),
        *cell_comoments("dp", "rate", "is_paid"), *cell_comoments("sp", "total_usd", days))
    cells = centred(cells, ["total", "days", "dp_x", "dp_y", "sp_x", "sp_y"])
    n, paid, overdue = F.sum("n"), F.sum("paid"), F.sum("overdue")
    flags = {"grp_tier": "tier_name", "grp_cycle": "billing_cycle", "grp_country": "country_code"}
    return cells.cube(*keys).agg(
        n.alias("total_invoices"), paid.alias("paid_count"), overdue.alias("overdue_count"),
        F.sum("discounted").alias("discounted_count"),
        percent(paid, n).alias("payment_rate_pct"), percent(overdue, n).alias("overdue_rate_pct"),
        mean_amount(F.sum("billed"), F.sum("total_n")).cast("double").alias("avg_invoice_usd"),
        F.expr(f"round({merged_stddev('total')}, 2) AS stddev_invoice_usd"),
        mean_amount(F.sum("rates"), F.sum("rated")).cast("double").alias("avg_discount_rate_pct"),
        F.expr(f"round({merged_stddev('days')}, 2) AS stddev_days_to_pay"),
        F.expr(f"round({merged_pearson('dp')}, 4) AS discount_payment_correlation"),
        F.expr(f"round({merged_pearson('sp')}, 4) AS invoice_size_payment_speed_corr"),
        F.grouping_id(*keys).cast("int").alias("_g"),
        *[F.expr(f"cast(grouping({k}) as int) AS {a}") for a, k in flags.items()])


def _cube_quantiles(base: DataFrame, keys: list[str]) -> DataFrame:
    """Rounded quantiles of the amount and of the payment delay per cube cell."""
    measured = base.selectExpr(*keys, """inline(array(
        struct('amount' AS measure, cast(total_usd * 100 as bigint) AS value),
        struct('delay' AS measure, cast(pay_seconds as bigint) AS value)))""")
    width = f"CASE measure WHEN 'amount' THEN {_CENTS_PER_BUCKET} ELSE {_SECONDS_PER_BUCKET} END"
    found = exact_quantiles(measured, ["measure"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, width, cube=keys)
    amounts = {"p25_invoice_usd": "q25", "median_invoice_usd": "q50", "p75_invoice_usd": "q75"}
    return found.groupBy("_g", *[f"_q{k}" for k in keys]).agg(
        *[F.expr(f"round(max(CASE measure WHEN 'amount' THEN {q} END)) / 100 AS {name}") for name, q in amounts.items()],
        F.expr(f"round(max(CASE measure WHEN 'delay' THEN q50 END) / {_SECONDS_PER_BUCKET}, 1) AS median_days_to_pay"),
    ).withColumnRenamed("_g", "_qg")


def cohort_retention(cohort: DataFrame) -> DataFrame:
    """Roll-up of start month and plan: subscriptions and users started, retained after 30 and 90
    days and churned, with percentages; totals per month and over everything."""
    measures = {"retained_30d": "retained_30d", "retained_90d": "retained_90d", "churned": "churned_flag"}
    # a row per month, plan and user, so that no subscription is repeated for the distinct users of each total
    per_user = cohort.groupBy("cohort_month", "tier_name", "user_id").agg(
        F.count(F.lit(1)).alias("started"), *[F.sum(c).alias(a) for a, c in measures.items()])
    started = F.sum("started")
    return per_user.rollup("cohort_month", "tier_name").agg(
        started.alias("subscriptions"), F.countDistinct("user_id").alias("users"),
        *[F.sum(a).alias(a) for a in measures],
        *[percent(F.sum(a), started).alias(f"{a}_pct") for a in measures],
        F.grouping("cohort_month").cast("int").alias("grp_month"), F.grouping("tier_name").cast("int").alias("grp_tier"))
