"""What is kept up to date or approximated: sketches, interval joins, stored pair counts, stored pages, SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from souklens.functions.sql import register_functions
from souklens.operators import intervals, pages, sketches
from souklens.session import new_path, written
from souklens.sources.market import Market
from souklens.sources.pair_store import PairStore
from souklens.workload import reports
from souklens.workload.datasets import staged_orders
from souklens.workload.published import CATALOG
from souklens.workload.registry import query

#: Share of the rows that a quantile's rank may be off; more than three times what the sketch promises.
RANK_BOUND = 0.01


@query("agg_quantile_sketch_cube", """
    SELECT status, date_part('year', billing_period_start)::INTEGER AS y, grouping(status, date_part('year', billing_period_start)::INTEGER) AS g,
        count(*) AS n, true AS median_near, true AS p90_near
    FROM sub_invoices GROUP BY CUBE (status, date_part('year', billing_period_start)::INTEGER)""", "sub_invoices")
def agg_quantile_sketch_cube(m: Market) -> DataFrame:
    """Quantiles of all groupings from one sketch for each finest cell, and whether the exact ranks are within the bound."""
    probs = {"median": 0.5, "p90": 0.9}
    invoices = m.subscription_invoices().select("status", F.year("billing_period_start").alias("y"), (F.col("total_usd") * 100).cast("long").alias("cents"))
    cells = written(sketches.quantile_cells(invoices, ["status", "y"], "cents"), "quantile_sketches")
    found = sketches.merged_quantiles(cells, ["status", "y"], probs, cube=True)
    # exact ranks from counts of values, reduced to the finest cells before they meet the groupings
    values = invoices.groupBy("status", "y", "cents").agg(F.count(F.lit(1)).alias("c")).withColumnsRenamed({"status": "_s", "y": "_y"})
    spread = values.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(
        F.when(F.col("_g") < 2, F.col("_s")).alias("_s"), F.when(F.col("_g") % 2 == 0, F.col("_y")).alias("_y"), "_g", "cents", "c")
    keys = F.col("_g").eqNullSafe(F.col("_group")) & F.col("status").eqNullSafe(F.col("_s")) & F.col("y").eqNullSafe(F.col("_y"))
    ranked = spread.join(found.withColumnRenamed("_g", "_group"), keys)
    near = []
    for name, p in probs.items():
        below = F.sum(F.when(F.col("cents") < F.col(name), F.col("c")).otherwise(0)) / F.max("n")
        upto = F.sum(F.when(F.col("cents") <= F.col(name), F.col("c")).otherwise(0)) / F.max("n")
        near.append(((below <= p + RANK_BOUND) & (upto >= p - RANK_BOUND)).alias(f"{name}_near"))
    return ranked.groupBy("status", "y", F.col("_group").alias("g")).agg(F.max("n").alias("n"), *near)


@query("agg_distinct_sketch_cube", """
    SELECT tier_id, date_part('year', started_at)::INTEGER AS y, grouping(tier_id, date_part('year', started_at)::INTEGER) AS g,
        count(DISTINCT user_id) AS users, true AS near
    FROM subscriptions GROUP BY CUBE (tier_id, date_part('year', started_at)::INTEGER)""", "subscriptions")
def agg_distinct_sketch_cube(m: Market) -> DataFrame:
    """Distinct users by plan and year, merged from sketches that are stored by month."""
    subs = m.subscriptions().withColumns({"month": F.date_trunc("month", "started_at"), "y": F.year("started_at")})
    stored = written(sketches.distinct_cells(subs, ["tier_id", "month"], "user_id"), "monthly_users")
    found = sketches.merged_distinct(stored.withColumn("y", F.year("month")), ["tier_id", "y"], "about", cube=True)
    exact = subs.cube("tier_id", "y").agg(F.count_distinct("user_id").alias("users"), F.grouping_id().alias("g"))
    found = found.withColumnsRenamed({"tier_id": "_t", "y": "_y"})
    same = F.col("tier_id").eqNullSafe(F.col("_t")) & F.col("y").eqNullSafe(F.col("_y")) & (F.col("g") == F.col("_g"))
    near = F.abs(F.col("about") - F.col("users")) <= 4 * sketches.distinct_error() * F.col("users") + 1
    return exact.join(found, same).select("tier_id", "y", "g", "users", near.alias("near"))


@query("join_price_interval", """
    WITH weeks AS (SELECT DISTINCT o_orderpriority AS tier, date_trunc('week', o_orderdate) AS week FROM orders),
    prices AS (SELECT tier, week AS price_from, CASE WHEN date_part('week', week) <> 30 THEN week + to_days(CAST(3 + date_part('week', week) % 8 AS INTEGER)) END AS price_to FROM weeks)
    SELECT s.id, s.tier_id, s.started_at, price_from FROM subscriptions s LEFT JOIN prices ON tier = s.tier_id AND s.started_at >= price_from
        AND (price_to IS NULL OR s.started_at < price_to)""", "subscriptions")
def join_price_interval(m: Market) -> DataFrame:
    """Hundreds of price periods for each plan, with gaps, overlaps and open ends."""
    weeks = m.raw("orders").select(F.col("o_orderpriority").alias("tier"), F.date_trunc("week", "o_orderdate").alias("price_from")).distinct()
    number = F.weekofyear("price_from")
    ends = F.when(number != 30, F.col("price_from") + F.make_dt_interval(days=3 + number % 8))
    prices = written(weeks.withColumn("price_to", ends), "weekly_prices")
    found = intervals.valid_at_join(m.subscriptions().select("id", "tier_id", "started_at"), prices, "tier_id", "started_at", "tier", "price_from", "price_to")
    return found.select("id", "tier_id", "started_at", "price_from")


@query("graph_pairs_maintained", "SELECT * FROM pairs", "pairs")
def graph_pairs_maintained(m: Market) -> DataFrame:
    """Counts loaded in three parts, one of them twice, compacted in between: as counted at once."""
    store = PairStore(m.spark, new_path(m.spark, "pair_store"))
    part = lambda n: m.order_items().where(F.pmod("order_id", F.lit(3)) == n)
    store.add(part(0), m.products())
    store.add(part(1), m.products())
    store.compact()
    store.add(part(1).unionByName(part(2)), m.products())
    store.add(part(0), m.products())
    return store.pairs()


_PAGE = 40


@query("page_deep", f"""
    SELECT * EXCLUDE (_at) FROM (
        SELECT *, row_number() OVER (ORDER BY grp_month, activity_month DESC NULLS FIRST, grp_country, country_code NULLS LAST) - 1 AS _at FROM ({reports.ENGAGEMENT_SQL}))
    WHERE _at // {_PAGE} IN (0, 17, 43)""", *reports.ENGAGEMENT_NEEDS)
def page_deep(m: Market) -> DataFrame:
    """Three pages of a result whose order mixes directions and places of NULL."""
    published = CATALOG["engagement-revenue"]
    stored = pages.PagedResult(m.spark, new_path(m.spark, "paged"), published.order).build(written(published.build(m), "to_page"))
    return stored.page(0, _PAGE).unionByName(stored.page(17, _PAGE)).unionByName(stored.page(43, _PAGE))


@query("sql_json_table", """
    SELECT CAST(id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_id, shipping_country, left(created_at, 10) AS day FROM orders_d WHERE status = 'F'""", "orders_d")
def sql_json_table(m: Market) -> DataFrame:
    """Staged documents read by a table function beside each of them."""
    register_functions(m.spark)
    staged_orders(m).createOrReplaceTempView("staged_order_documents")
    return m.spark.sql("""
        SELECT o.id, o.user_id, o.shipping_country, left(o.created_at, 10) AS day
        FROM staged_order_documents d, LATERAL json_orders(d.json_doc) o WHERE o.status = 'F'""")


@query("sql_base64_to_uuid", """
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN
        substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) END AS uuid
    FROM (SELECT p_partkey, md5(p_name || p_partkey) AS h FROM part)""")
def sql_base64_to_uuid(m: Market) -> DataFrame:
    register_functions(m.spark)
    m.raw("part").createOrReplaceTempView("sql_parts")
    return m.spark.sql("""
        SELECT p_partkey, base64_to_uuid(CASE p_partkey % 4 WHEN 0 THEN base64(unhex(md5(concat(p_name, p_partkey)))) WHEN 1 THEN '  ' WHEN 2 THEN '@@@' ELSE 'AAAA' END) AS uuid
        FROM sql_parts""")
