"""Single operators on the raw tables: projections, joins, aggregates, windows, order and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from souklens.functions.numbers import mean_amount, nvl, pearson, percent, ratio, sample_stddev
from souklens.functions.times import month_of
from souklens.operators.joins import detail_left_join, latest_per_key, null_safe, valid_at
from souklens.operators.quantiles import exact_quantiles
from souklens.operators.rankings import newest_rows, page, page_after, rank_and_running_total
from souklens.sources.market import Market
from souklens.workload.registry import query
from souklens.workload.tables_sql import pct, rounded

_TO_HERE = (Window.unboundedPreceding, Window.currentRow)


def money(name: str, precision: int = 12):
    return F.col(name).cast(f"decimal({precision},2)")


# projections and predicates -----------------------------------------------------------------


@query("product_point_lookup", "SELECT count(*) AS matches FROM part WHERE p_partkey = 77")
def product_point_lookup(m: Market) -> DataFrame:
    return m.raw("part").filter(F.col("p_partkey") == 77).agg(F.count(F.lit(1)).alias("matches"))


@query("events_since", """
    SELECT event_type, count(*) AS n, min(ts) AS first_at FROM events WHERE ts >= TIMESTAMP '2024-01-24' GROUP BY 1""")
def events_since(m: Market) -> DataFrame:
    recent = m.raw("events").filter(F.col("ts") >= F.lit("2024-01-24 00:00:00").cast("timestamp_ntz"))
    return recent.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_at"))


@query("active_products", """
    SELECT product_type, count(*) FILTER (is_active) AS active, count(*) AS total FROM products GROUP BY 1""", "products")
def active_products(m: Market) -> DataFrame:
    return m.products().groupBy("product_type").agg(F.count_if("is_active").alias("active"), F.count(F.lit(1)).alias("total"))


@query("case_buckets", """
    SELECT CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS bucket,
        l_returnflag IN ('A', 'R') AS came_back, count(*) AS n FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1, 2""")
def case_buckets(m: Market) -> DataFrame:
    size = F.when(F.col("l_quantity") < 10, "small").when(F.col("l_quantity") < 30, "medium").otherwise("large")
    kept = m.raw("lineitem").filter(F.col("l_shipdate").isNotNull())
    return kept.groupBy(size.alias("bucket"), F.col("l_returnflag").isin("A", "R").alias("came_back")).agg(F.count(F.lit(1)).alias("n"))


@query("typed_null_columns", """
    SELECT o_orderkey AS id, CAST(o_totalprice AS DOUBLE) AS amount, CAST(NULL AS TIMESTAMP) AS paid_at, CAST(NULL AS VARCHAR) AS kind FROM orders""")
def typed_null_columns(m: Market) -> DataFrame:
    return m.raw("orders").select(
        F.col("o_orderkey").alias("id"), money("o_totalprice").alias("amount"),
        F.lit(None).cast("timestamp").alias("paid_at"), F.lit(None).cast("string").alias("kind"))


# joins --------------------------------------------------------------------------------------


@query("join_inner_equi", """
    SELECT n_name, o_orderstatus, count(*) AS lines, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS revenue
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
    JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2""")
def join_inner_equi(m: Market) -> DataFrame:
    per_order = m.raw("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum(money("l_extendedprice")).alias("r"))
    customers = m.raw("customer").join(m.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return m.raw("orders").join(per_order, F.col("o_orderkey") == F.col("l_orderkey")).join(
        customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name", "o_orderstatus").agg(
        F.sum("n").alias("lines"), F.sum("r").alias("revenue"))


@query("join_left_equi", """
    SELECT c.id, c.full_name, o.id AS order_id, o.status FROM users c LEFT JOIN orders_d o ON o.user_id = c.id""", "users", "orders_d")
def join_left_equi(m: Market) -> DataFrame:
    orders = m.order_headers().select(F.col("user_id").alias("_buyer"), F.col("id").alias("order_id"), "status")
    return detail_left_join(m.users().select("id", "full_name"), orders, "id", "_buyer").drop("_buyer")


@query("join_left_multikey", """
    WITH sales AS (SELECT o_custkey, date_trunc('month', o_orderdate) AS month, count(*) AS n_orders FROM orders GROUP BY 1, 2),
    shipped AS (SELECT o_custkey, date_trunc('month', l_shipdate) AS month, count(*) AS n_lines
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2)
    SELECT sales.*, coalesce(n_lines, 0) AS n_lines FROM sales
    LEFT JOIN shipped ON shipped.o_custkey = sales.o_custkey AND shipped.month = sales.month""")
def join_left_multikey(m: Market) -> DataFrame:
    orders = m.raw("orders")
    sales = orders.groupBy("o_custkey", month_of(F.col("o_orderdate")).alias("month")).agg(F.count(F.lit(1)).alias("n_orders"))
    per_order = m.raw("lineitem").groupBy("l_orderkey", month_of(F.col("l_shipdate")).alias("month")).agg(F.count(F.lit(1)).alias("n"))
    shipped = per_order.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        "o_custkey", "month").agg(F.sum("n").alias("n_lines"))
    return sales.join(shipped, ["o_custkey", "month"], "left").select("o_custkey", "month", "n_orders", nvl(F.col("n_lines"), 0).alias("n_lines"))


@query("join_price_valid_at", """
    SELECT s.id, s.tier_id, s.started_at, p.id AS price_id, CAST(p.monthly_price_usd AS DOUBLE) AS monthly_price_usd
    FROM subscriptions s LEFT JOIN pricing p ON p.tier_id = s.tier_id AND s.started_at >= p.valid_from
        AND (p.valid_to IS NULL OR s.started_at < p.valid_to)""", "subscriptions", "pricing")
def join_price_valid_at(m: Market) -> DataFrame:
    prices = m.tier_pricing().select(F.col("id").alias("price_id"), F.col("tier_id").alias("_t"), "monthly_price_usd", "valid_from", "valid_to")
    match = (F.col("tier_id") == F.col("_t")) & valid_at(F.col("valid_from"), F.col("valid_to"), F.col("started_at"))
    return m.subscriptions().select("id", "tier_id", "started_at").join(prices, match, "left").drop("_t", "valid_from", "valid_to")


@query("join_null_safe", """
    WITH a AS (SELECT country_code, count(*) AS users FROM users GROUP BY 1),
    b AS (SELECT country_code, count(*) AS orders FROM users JOIN orders_d o ON o.user_id = users.id GROUP BY 1)
    SELECT a.country_code, users, orders FROM a LEFT JOIN b ON b.country_code IS NOT DISTINCT FROM a.country_code""", "users", "orders_d")
def join_null_safe(m: Market) -> DataFrame:
    users = m.users()
    a = users.groupBy("country_code").agg(F.count(F.lit(1)).alias("users"))
    per_user = m.order_headers().groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    b = per_user.join(users, F.col("user_id") == F.col("id")).groupBy(F.col("country_code").alias("_c")).agg(F.sum("n").alias("orders"))
    return a.join(b, null_safe([(F.col("country_code"), F.col("_c"))]), "left").drop("_c")


@query("join_dim_twice", """
    SELECT l_returnflag, a.p_type AS own_type, b.p_type AS next_type, count(*) AS n
    FROM lineitem JOIN part a ON a.p_partkey = l_partkey LEFT JOIN part b ON b.p_partkey = l_partkey + 1 GROUP BY 1, 2, 3""")
def join_dim_twice(m: Market) -> DataFrame:
    lines = m.raw("lineitem").groupBy("l_returnflag", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    a = m.raw("part").select(F.col("p_partkey").alias("_a"), F.col("p_type").alias("own_type"))
    b = m.raw("part").select(F.col("p_partkey").alias("_b"), F.col("p_type").alias("next_type"))
    return lines.join(a, F.col("l_partkey") == F.col("_a")).join(b, F.col("l_partkey") + 1 == F.col("_b"), "left").groupBy(
        "l_returnflag", "own_type", "next_type").agg(F.sum("n").alias("n"))


@query("join_cross_scalar", """
    WITH per_user AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
    SELECT o_custkey, n, n >= (SELECT avg(n) FROM per_user) AS above_mean FROM per_user""")
def join_cross_scalar(m: Market) -> DataFrame:
    """A one-row aggregate beside every row, as a scalar subquery."""
    per_user = m.raw("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    mean = per_user.agg(F.avg("n")).scalar()
    return per_user.select("o_custkey", "n", (F.col("n") >= mean).alias("above_mean"))


@query("join_latest_subscription", """
    WITH latest AS (SELECT * FROM (
        SELECT user_id, id AS sub_id, tier_id, row_number() OVER (PARTITION BY user_id ORDER BY started_at DESC NULLS FIRST, id DESC) AS rn
        FROM subscriptions) WHERE rn = 1)
    SELECT u.id, u.full_name, sub_id, tier_id FROM users u LEFT JOIN latest ON user_id = u.id""", "users", "subscriptions")
def join_latest_subscription(m: Market) -> DataFrame:
    subs = m.subscriptions().withColumnRenamed("id", "sub_id")
    latest = latest_per_key(subs, "user_id", "started_at", "sub_id", ["sub_id", "tier_id"])
    return m.users().select("id", "full_name").join(latest, F.col("id") == F.col("user_id"), "left").drop("user_id")


@query("join_window_back", """
    WITH r AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderpriority) AS g, grouping(o_orderstatus) AS gs
        FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)),
    t AS (SELECT o_orderstatus AS s, n AS status_total, CAST(sum(n) OVER (ORDER BY o_orderstatus ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running
        FROM r WHERE g = 1 AND gs = 0)
    SELECT o_orderstatus, o_orderpriority, n, status_total, running FROM r LEFT JOIN t ON s = o_orderstatus""")
def join_window_back(m: Market) -> DataFrame:
    rolled = m.raw("orders").rollup("o_orderstatus", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("o_orderpriority").alias("g"), F.grouping("o_orderstatus").alias("gs"))
    totals = rolled.filter((F.col("g") == 1) & (F.col("gs") == 0)).select(
        F.col("o_orderstatus").alias("s"), F.col("n").alias("status_total"),
        F.sum("n").over(Window.orderBy("o_orderstatus").rowsBetween(*_TO_HERE)).alias("running"))
    return rolled.join(totals, F.col("o_orderstatus") == F.col("s"), "left").drop("s", "g", "gs")


# aggregates ---------------------------------------------------------------------------------


@query("agg_group_by", """
    SELECT l_returnflag, l_linestatus, date_trunc('month', l_shipdate) AS month, CAST(sum(l_quantity) AS DOUBLE) AS quantity,
        count(*) AS n FROM lineitem GROUP BY 1, 2, 3""")
def agg_group_by(m: Market) -> DataFrame:
    return m.raw("lineitem").groupBy("l_returnflag", "l_linestatus", month_of(F.col("l_shipdate")).alias("month")).agg(
        F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n"))


@query("agg_conditional_counts", """
    SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks,
        count(*) FILTER (event_type = 'purchase') AS purchases, count(*) AS total FROM events GROUP BY 1""")
def agg_conditional_counts(m: Market) -> DataFrame:
    kinds = {"views": "view", "clicks": "click", "purchases": "purchase"}
    return m.raw("events").groupBy("user_id").agg(
        *[F.count_if(F.col("event_type") == kind).alias(name) for name, kind in kinds.items()], F.count(F.lit(1)).alias("total"))


@query("agg_count", """
    SELECT count(*) AS all_users, count(country_code) AS with_country, count(last_login_at) AS with_login FROM users""", "users")
def agg_count(m: Market) -> DataFrame:
    return m.users().agg(F.count(F.lit(1)).alias("all_users"), F.count("country_code").alias("with_country"),
                         F.count("last_login_at").alias("with_login"))


@query("agg_count_distinct", """
    SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1""")
def agg_count_distinct(m: Market) -> DataFrame:
    return m.raw("lineitem").groupBy("l_returnflag").agg(
        F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("agg_sum_nvl", """
    SELECT user_id, CAST(sum(coalesce(CASE WHEN status <> 'pending' THEN 1 END, 0)) AS BIGINT) AS settled,
        CAST(sum(coalesce(CASE WHEN status = 'paid' THEN total_usd END, 0)) AS DOUBLE) AS paid_usd
    FROM sub_invoices GROUP BY 1""", "sub_invoices")
def agg_sum_nvl(m: Market) -> DataFrame:
    settled = F.when(F.col("status") != "pending", 1)
    paid = F.when(F.col("status") == "paid", F.col("total_usd"))
    return m.subscription_invoices().groupBy("user_id").agg(
        F.sum(nvl(settled, 0)).alias("settled"), F.sum(F.coalesce(paid, F.lit(0).cast("decimal(12,2)"))).alias("paid_usd"))


@query("agg_avg", f"""
    SELECT o_orderstatus, {rounded('sum(CAST(round(o_totalprice * 100) AS BIGINT))', 'count(*)', 0)} / 100.0 AS mean_price,
        {rounded('(SELECT sum(CAST(round(o_totalprice * 100) AS BIGINT)) FROM orders)', '(SELECT count(*) FROM orders)', 0)} / 100.0 AS overall_mean
    FROM orders GROUP BY 1""")
def agg_avg(m: Market) -> DataFrame:
    per_status = m.raw("orders").groupBy("o_orderstatus").agg(F.sum(money("o_totalprice")).alias("s"), F.count(F.lit(1)).alias("n"))
    overall = per_status.agg(mean_amount(F.sum("s"), F.sum("n"))).scalar()
    return per_status.select("o_orderstatus", mean_amount(F.col("s"), F.col("n")).alias("mean_price"), overall.alias("overall_mean"))


def _price_quantiles(m: Market, probs: dict[str, float]) -> DataFrame:
    cents = exact_quantiles(
        m.raw("lineitem"), ["l_returnflag"], "cast(l_extendedprice as decimal(12,2)) * 100", probs, width=100_000)
    return cents.selectExpr("l_returnflag", *[f"round({p}) / 100 AS {p}" for p in probs])


@query("agg_median", f"""
    SELECT l_returnflag, round(quantile_cont(CAST(round(l_extendedprice * 100) AS BIGINT), 0.5)) / 100.0 AS median_price
    FROM lineitem GROUP BY 1""")
def agg_median(m: Market) -> DataFrame:
    return _price_quantiles(m, {"median_price": 0.5})


@query("agg_percentile_cont", """
    SELECT l_returnflag, round(quantile_cont(CAST(round(l_extendedprice * 100) AS BIGINT), 0.25)) / 100.0 AS p25,
        round(quantile_cont(CAST(round(l_extendedprice * 100) AS BIGINT), 0.75)) / 100.0 AS p75,
        round(quantile_cont(CAST(round(l_extendedprice * 100) AS BIGINT), 0.99)) / 100.0 AS p99 FROM lineitem GROUP BY 1""")
def agg_percentile_cont(m: Market) -> DataFrame:
    return _price_quantiles(m, {"p25": 0.25, "p75": 0.75, "p99": 0.99})


@query("agg_stddev", """
    SELECT l_orderkey, round(CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(l_quantity) END, 6) AS spread FROM lineitem GROUP BY 1""")
def agg_stddev(m: Market) -> DataFrame:
    return m.raw("lineitem").groupBy("l_orderkey").agg(F.round(sample_stddev(F.col("l_quantity")), 6).alias("spread"))


@query("agg_corr", """
    SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS size_price,
        CASE WHEN min(l_quantity) < max(l_quantity) AND min(constant) < max(constant) THEN corr(l_quantity, constant) END AS size_constant
    FROM (SELECT *, CASE WHEN l_returnflag = 'N' THEN l_linenumber % 1 ELSE 0 END AS constant FROM lineitem) GROUP BY 1""")
def agg_corr(m: Market) -> DataFrame:
    return m.raw("lineitem").groupBy("l_returnflag").agg(
        F.round(pearson(F.col("l_quantity"), F.col("l_extendedprice")), 6).alias("size_price"),
        pearson(F.col("l_quantity"), F.col("l_linenumber") % 1).alias("size_constant"))


_GROUPED = "count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total"


def _grouped():
    return [F.count(F.lit(1)).alias("n"), F.sum(money("o_totalprice")).alias("total")]


@query("agg_rollup", f"""
    SELECT date_trunc('month', o_orderdate) AS month, o_orderstatus, {_GROUPED} FROM orders GROUP BY ROLLUP (1, 2)""".replace(
    "ROLLUP (1, 2)", "ROLLUP (date_trunc('month', o_orderdate), o_orderstatus)"))
def agg_rollup(m: Market) -> DataFrame:
    return m.raw("orders").withColumn("month", month_of(F.col("o_orderdate"))).rollup("month", "o_orderstatus").agg(*_grouped())


@query("agg_cube", f"""
    SELECT o_orderstatus, o_orderpriority, year, {_GROUPED} FROM (SELECT *, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders)
    GROUP BY CUBE (o_orderstatus, o_orderpriority, year)""")
def agg_cube(m: Market) -> DataFrame:
    fine = m.raw("orders").groupBy("o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("year")).agg(*_grouped())
    return fine.cube("o_orderstatus", "o_orderpriority", "year").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@query("agg_grouping_sets", f"""
    SELECT o_orderstatus, o_orderpriority, {_GROUPED} FROM orders
    GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())""")
def agg_grouping_sets(m: Market) -> DataFrame:
    keys = ["o_orderstatus", "o_orderpriority"]
    fine = m.raw("orders").groupBy(*keys).agg(*_grouped())
    return fine.groupingSets([keys, keys[1:], []], *keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@query("agg_grouping_flag", """
    SELECT country_code, city, count(*) AS n, CAST(grouping(country_code) AS INTEGER) AS grp_country, CAST(grouping(city) AS INTEGER) AS grp_city,
        CASE WHEN grouping(country_code) = 1 THEN 'Grand Total' WHEN grouping(city) = 1 THEN 'Country Subtotal' ELSE 'Detail' END AS label
    FROM users GROUP BY ROLLUP (country_code, city)""", "users")
def agg_grouping_flag(m: Market) -> DataFrame:
    """A country that is NULL in the data is told from a subtotal by the flag."""
    label = F.when(F.grouping("country_code") == 1, "Grand Total").when(F.grouping("city") == 1, "Country Subtotal").otherwise("Detail")
    return m.users().rollup("country_code", "city").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("country_code").cast("int").alias("grp_country"),
        F.grouping("city").cast("int").alias("grp_city"), label.alias("label"))


@query("agg_min_max", "SELECT event_type, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1")
def agg_min_max(m: Market) -> DataFrame:
    return m.raw("events").groupBy("event_type").agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query("agg_ratio_pct", f"""
    SELECT user_id, {pct("count(*) FILTER (event_type = 'purchase')", 'count(*)')} AS purchase_pct,
        {rounded("count(*)", "count(*) FILTER (event_type = 'signup')")} AS events_per_signup FROM events GROUP BY 1""")
def agg_ratio_pct(m: Market) -> DataFrame:
    total, bought, signed = F.count(F.lit(1)), F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type") == "signup")
    return m.raw("events").groupBy("user_id").agg(percent(bought, total).alias("purchase_pct"), ratio(total, signed).alias("events_per_signup"))


# windows, each over an aggregate with few rows per partition ---------------------------------


_MONTHLY = """WITH monthly AS (
        SELECT o_orderstatus, date_trunc('month', o_orderdate) AS month, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(12,2))) AS total
        FROM orders GROUP BY 1, 2) """


def monthly_orders(m: Market) -> DataFrame:
    return m.raw("orders").groupBy("o_orderstatus", month_of(F.col("o_orderdate")).alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(money("o_totalprice")).alias("total"))


def in_status():
    return Window.partitionBy("o_orderstatus").orderBy("month")


@query("win_row_number_latest", """
    SELECT o_custkey, o_orderkey, o_orderdate FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey DESC) AS rn FROM orders)
    WHERE rn = 1""")
def win_row_number_latest(m: Market) -> DataFrame:
    return latest_per_key(m.raw("orders"), "o_custkey", "o_orderdate", "o_orderkey", ["o_orderkey", "o_orderdate"])


@query("win_rank", _MONTHLY + """
    SELECT o_orderstatus, month, n, CAST(rank() OVER (ORDER BY n DESC) AS INTEGER) AS overall,
        CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY n DESC) AS INTEGER) AS in_status FROM monthly""")
def win_rank(m: Market) -> DataFrame:
    by_n = F.desc("n")
    return monthly_orders(m).select(
        "o_orderstatus", "month", "n", F.rank().over(Window.orderBy(by_n)).alias("overall"),
        F.rank().over(Window.partitionBy("o_orderstatus").orderBy(by_n)).alias("in_status"))


@query("win_rank_large_groups", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, q,
        rank() OVER (PARTITION BY l_returnflag ORDER BY q DESC) AS rank_in_flag,
        CAST(sum(q) OVER (PARTITION BY l_linestatus ORDER BY q DESC,
            md5(l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey), l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_quantity
    FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM lineitem)""")
def win_rank_large_groups(m: Market) -> DataFrame:
    """Rank and running total over groups that each hold a large share of the table."""
    ids = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = m.raw("lineitem").select(*ids, "l_returnflag", "l_linestatus", F.col("l_quantity").cast("long").alias("q"))
    return rank_and_running_total(rows, "l_returnflag", "l_linestatus", "q", ids, "rank_in_flag", "running_quantity")


@query("win_ntile", """
    WITH per_nation AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1)
    SELECT c_nationkey, n, CAST(ntile(4) OVER (ORDER BY n DESC, c_nationkey) AS INTEGER) AS quartile FROM per_nation""")
def win_ntile(m: Market) -> DataFrame:
    per_nation = m.raw("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return per_nation.withColumn("quartile", F.ntile(4).over(Window.orderBy(F.desc("n"), "c_nationkey")))


@query("win_running_sum", _MONTHLY + """
    SELECT o_orderstatus, month, CAST(sum(total) OVER (PARTITION BY o_orderstatus ORDER BY month ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running FROM monthly""")
def win_running_sum(m: Market) -> DataFrame:
    return monthly_orders(m).select("o_orderstatus", "month", F.sum("total").over(in_status().rowsBetween(*_TO_HERE)).alias("running"))


@query("win_rolling_avg", _MONTHLY + """
    SELECT o_orderstatus, month, round(avg(n) OVER (PARTITION BY o_orderstatus ORDER BY month ROWS 2 PRECEDING), 6) AS rolling FROM monthly""")
def win_rolling_avg(m: Market) -> DataFrame:
    return monthly_orders(m).select("o_orderstatus", "month", F.round(F.avg("n").over(in_status().rowsBetween(-2, 0)), 6).alias("rolling"))


@query("win_lag", _MONTHLY + """
    SELECT o_orderstatus, month, lag(n) OVER w AS previous, lag(n, 12) OVER w AS prior_year FROM monthly
    WINDOW w AS (PARTITION BY o_orderstatus ORDER BY month)""")
def win_lag(m: Market) -> DataFrame:
    return monthly_orders(m).select("o_orderstatus", "month", F.lag("n").over(in_status()).alias("previous"),
                                    F.lag("n", 12).over(in_status()).alias("prior_year"))


@query("win_lead", _MONTHLY + """
    SELECT o_orderstatus, month, lead(n, 1, NULL) OVER (PARTITION BY o_orderstatus ORDER BY month) AS following FROM monthly""")
def win_lead(m: Market) -> DataFrame:
    return monthly_orders(m).select("o_orderstatus", "month", F.lead("n", 1).over(in_status()).alias("following"))


@query("win_first_value", _MONTHLY + """
    SELECT o_orderstatus, month, first_value(n) OVER (PARTITION BY o_orderstatus ORDER BY month ROWS UNBOUNDED PRECEDING) AS first_n FROM monthly""")
def win_first_value(m: Market) -> DataFrame:
    return monthly_orders(m).select("o_orderstatus", "month", F.first("n").over(in_status().rowsBetween(*_TO_HERE)).alias("first_n"))


@query("win_last_value", _MONTHLY + """
    SELECT o_orderstatus, month, last_value(n) OVER (PARTITION BY o_orderstatus ORDER BY month
        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_n FROM monthly""")
def win_last_value(m: Market) -> DataFrame:
    whole = in_status().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return monthly_orders(m).select("o_orderstatus", "month", F.last("n").over(whole).alias("last_n"))


@query("win_percentile_over", _MONTHLY + """
    SELECT o_orderstatus, month, n, round(quantile_cont(n, 0.66) OVER (), 6) AS p66 FROM monthly""")
def win_percentile_over(m: Market) -> DataFrame:
    p66 = F.percentile("n", F.lit(0.66)).over(Window.partitionBy())
    return monthly_orders(m).select("o_orderstatus", "month", "n", F.round(p66, 6).alias("p66"))


@query("win_ratio_to_report", _MONTHLY + f"""
    SELECT o_orderstatus, month, {pct('n', 'sum(n) OVER ()', 4)} AS share_pct FROM monthly""")
def win_ratio_to_report(m: Market) -> DataFrame:
    return monthly_orders(m).select("o_orderstatus", "month", percent(F.col("n"), F.sum("n").over(Window.partitionBy()), 4).alias("share_pct"))


@query("win_conditional", """
    WITH r AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderpriority) AS sub
        FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus)))
    SELECT o_orderstatus, o_orderpriority, n,
        CASE WHEN sub = 0 THEN CAST(rank() OVER (PARTITION BY o_orderstatus, sub ORDER BY n DESC) AS INTEGER) END AS rank_in_status FROM r""")
def win_conditional(m: Market) -> DataFrame:
    keys = ["o_orderstatus", "o_orderpriority"]
    rows = m.raw("orders").groupingSets([keys, keys[:1]], *keys).agg(
        F.count(F.lit(1)).alias("n"), F.grouping("o_orderpriority").alias("sub"))
    ranked = F.rank().over(Window.partitionBy("o_orderstatus", "sub").orderBy(F.desc("n")))
    return rows.select(*keys, "n", F.when(F.col("sub") == 0, ranked).alias("rank_in_status"))


@query("win_growth_pct", _MONTHLY + f""", seen AS (
        SELECT *, lag(n) OVER (PARTITION BY o_orderstatus ORDER BY month) AS prev FROM monthly)
    SELECT o_orderstatus, month, {pct('(n - prev)', 'prev')} AS growth_pct FROM seen""")
def win_growth_pct(m: Market) -> DataFrame:
    before = F.lag("n").over(in_status())
    return monthly_orders(m).select("o_orderstatus", "month", percent(F.col("n") - before, before).alias("growth_pct"))


# order, limits and sets ---------------------------------------------------------------------


@query("sort_multi", "SELECT id, country_code, last_login_at FROM users ORDER BY country_code DESC NULLS LAST, last_login_at NULLS FIRST, id", "users")
def sort_multi(m: Market) -> DataFrame:
    return m.users().select("id", "country_code", "last_login_at").orderBy(
        F.desc_nulls_last("country_code"), F.asc_nulls_first("last_login_at"), "id")


@query("topk_recent", "SELECT id, user_id, status, created_at FROM orders_d ORDER BY created_at DESC NULLS FIRST, id LIMIT 10000", "orders_d")
def topk_recent(m: Market) -> DataFrame:
    return newest_rows(m.orders().select("id", "user_id", "status", "created_at"), "created_at", "id", 10_000)


@query("topk_items_by_id", "SELECT id, order_id, product_id, quantity FROM order_items ORDER BY id LIMIT 10000", "order_items")
def topk_items_by_id(m: Market) -> DataFrame:
    return m.order_items().select("id", "order_id", "product_id", "quantity").orderBy("id").limit(10_000)


@query("page", "SELECT id, status, created_at FROM orders_d ORDER BY created_at DESC, id LIMIT 1000 OFFSET 1000", "orders_d")
def second_page(m: Market) -> DataFrame:
    return page(m.orders().select("id", "status", "created_at"), [F.desc("created_at"), F.asc("id")], 1000, 1)


@query("page_after_key", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 777 ORDER BY o_orderkey LIMIT 1000")
def page_after_key(m: Market) -> DataFrame:
    return page_after(m.raw("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", F.lit(777), 1000)


@query("set_union_all", """
    SELECT country_code, count(*) AS n FROM (SELECT country_code FROM users UNION ALL SELECT country_code FROM sellers
        UNION ALL SELECT shipping_country FROM orders_d) GROUP BY 1""", "users", "sellers", "orders_d")
def set_union_all(m: Market) -> DataFrame:
    places = m.users().select("country_code").unionByName(m.sellers().select("country_code")).unionByName(
        m.orders().select(F.col("shipping_country").alias("country_code")))
    return places.groupBy("country_code").agg(F.count(F.lit(1)).alias("n"))


@query("set_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation")
def set_union_distinct(m: Market) -> DataFrame:
    sides = [("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey")]
    a, b, c = (m.raw(table).select(F.col(key).alias("k")) for table, key in sides)
    return a.union(b).union(c).distinct()


@query("distinct", "SELECT DISTINCT l_partkey, l_returnflag FROM lineitem")
def distinct_rows(m: Market) -> DataFrame:
    return m.raw("lineitem").select("l_partkey", "l_returnflag").distinct()
