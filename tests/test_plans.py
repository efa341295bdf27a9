"""What the physical plans must show: pruned scans, pushed filters, split skew, bounded windows."""

from __future__ import annotations

import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from souklens.operators import joins, quantiles, rankings
from souklens.plans import consolidation, dimensions, facts, reports
from souklens.sources.market import Market
from souklens.workload import QUERIES

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    df.collect()
    return plan_of(df).split("== Initial Plan ==")[0]


@contextmanager
def settings(spark, **values):
    values = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def tiny_skew(spark):
    """Joins as on large tables: nothing is broadcast, and a partition of some kilobytes counts as skewed."""
    with settings(spark, **{
            "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2000", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2000", "spark.sql.shuffle.partitions": "8"}):
        yield


def hot(key, other, share=3):
    """``key`` for a third of the rows, otherwise ``other``."""
    return F.when(F.col("i") % share == 0, F.lit(key)).otherwise(other)


def test_hot_order_is_split_in_the_detail_join(spark, tiny_skew):
    orders = spark.range(0, 500, 1, 4)
    items = spark.range(0, 6000, 1, 8).withColumnRenamed("id", "i").select("i", hot(7, F.col("i") % 400).alias("order_id"))
    df = joins.detail_left_join(orders, items, "id", "order_id", split_above=1000)
    assert "skew=true" in final_plan(df)
    assert df.count() == 6000 + 100  # orders 400 to 499 have no line


def test_hot_and_missing_products_are_split_in_the_activity_join(spark, tiny_skew):
    from souklens.plans import consolidation
    users = spark.range(0, 50, 1, 2).select("id", *[F.lit("x").alias(c) for c in ("email", "full_name", "country_code", "city", "created_at", "last_login_at", "is_active")])
    events = spark.range(0, 6000, 1, 8).withColumnRenamed("id", "i").select(
        F.col("i").alias("id"), hot(3, F.col("i") % 50).alias("user_id"), F.lit("search").alias("event_type"),
        F.when(F.col("i") % 2 == 0, F.col("i") % 40).alias("product_id"), F.lit("{}").alias("metadata"), F.lit("2024-01-01T00:00:00Z").alias("occurred_at"))
    products = spark.range(0, 40, 1, 2).select(F.col("id").alias("product_id"), *[F.lit("x").alias(c) for c in ("name", "product_type", "seller_id", "price_usd", "is_active")])
    df = consolidation.user_activity(users, events, products)
    assert "skew=true" in final_plan(df)
    assert df.count() == 6000


def test_reports_read_only_the_columns_they_use(spark):
    m = Market(spark, SF)
    plan = plan_of(reports.engagement_revenue_monthly(m.users(), m.events(), m.order_headers(), m.order_items()))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    columns = {re.sub(r"#\d+L?", "", c) for scan in scans for c in scan.split(",") if c}
    assert columns == {"l_orderkey", "l_quantity", "l_extendedprice", "o_orderkey", "o_custkey", "o_orderdate", "event_id", "ts",
                       "user_id", "event_type", "c_custkey", "c_nationkey", "n_nationkey", "n_name"}


def test_paid_filter_reaches_a_stored_table(spark, tmp_path):
    m = Market(spark, SF)
    m.subscription_invoices().write.parquet(str(tmp_path / "invoices"))
    stored = spark.read.parquet(str(tmp_path / "invoices"))
    plan = plan_of(reports.subscription_billing_trend(stored, m.subscriptions(), m.tiers()))
    assert "EqualTo(status,paid)" in plan


def test_windows_follow_aggregates(spark):
    """No window of a report sorts raw rows: between a scan and a window lies an aggregate."""
    m = Market(spark, SF)
    cohort = facts.sub_cohort(facts.user_subscription(m.users(), m.subscriptions(), m.tiers(), m.tier_pricing()), F.current_timestamp())
    for df in (reports.engagement_revenue_monthly(m.users(), m.events(), m.order_headers(), m.order_items()),
               reports.subscription_billing_trend(m.subscription_invoices(), m.subscriptions(), m.tiers()),
               reports.sub_retention_cohort(cohort)):
        lines = plan_of(df).split("\n")
        windows = [i for i, line in enumerate(lines) if re.search(r"[+:]- (\*\(\d+\) )?Window", line)]
        aggregates = [i for i, line in enumerate(lines) if "HashAggregate" in line]
        assert windows and max(windows) < min(aggregates)


def test_invoices_are_moved_once(spark):
    """Above the scan of lines, which are most of the invoices, lies one exchange also when nothing is broadcast."""
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        lines = plan_of(QUERIES["cons_invoices"](spark, SF)).split("\n")
    at = next(i for i, line in enumerate(lines) if "FileScan parquet [l_orderkey" in line)
    depth, above = re.search(r"\w", lines[at]).start(), []
    for line in reversed(lines[:at]):
        if (found := re.search(r"[\w*]", line)) and found.start() < depth:
            depth = found.start()
            above.append(line)
    assert sum("Exchange" in line for line in above) == 1


def test_invoices_named_by_order_are_those_named_by_user(spark):
    m = Market(spark, SF)
    users = m.users().filter("id % 3 != 0").unionByName(m.users().filter("id = 7"))  # some unknown, one twice
    names = consolidation.user_names(users)
    market = m.marketplace_invoices().join(names, F.col("user_id") == F.col("user_id_ref"))
    by_order = consolidation.invoices(m.subscription_invoices(names), market)
    by_user = consolidation.invoices(m.subscription_invoices(), m.marketplace_invoices(), users)
    assert by_order.columns == by_user.columns and by_order.count() > 1000
    assert by_order.exceptAll(by_user).isEmpty() and by_user.exceptAll(by_order).isEmpty()


def test_ranked_rows_are_moved_once(spark):
    rows = Market(spark, SF).raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("long").alias("q"))
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        plan = plan_of(rankings.rank_and_running_total(rows, "l_returnflag", "l_linestatus", "q", ["l_orderkey", "l_linenumber", "l_partkey"], "r", "t"))
    left = plan[plan.index("SortMergeJoin"):plan.index("FileScan")]
    assert left.count("Exchange") == 1


def test_a_large_tie_is_split_over_cells(spark, monkeypatch):
    """``digits`` follows from the histogram: a tie above the rows of a cell is numbered in several of them."""
    rows = Market(spark, SF).raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.lit("x").alias("g"), F.lit(1).cast("long").alias("q"))
    for most, least_cells, most_cells in ((10_000_000, 1, 1), (1_000, 16, 16), (100, 200, 256)):
        monkeypatch.setattr(rankings, "CELL_ROWS", most)
        seen = []
        kept = rankings.written
        monkeypatch.setattr(rankings, "written", lambda df, name: seen.append(kept(df, name)) or seen[-1])
        rankings.rank_and_running_total(rows, "g", "g", "q", ["l_orderkey", "l_linenumber", "l_partkey"], "r", "t")
        monkeypatch.setattr(rankings, "written", kept)
        assert least_cells <= seen[-1].count() <= most_cells


def test_quantiles_move_only_rows_of_located_buckets(spark):
    rows = Market(spark, SF).raw("lineitem")
    plan = plan_of(quantiles.exact_quantiles(rows, ["l_returnflag"], "cast(l_extendedprice * 100 as bigint)", {"m": 0.5}, 100_000))
    scan_to_join = plan[plan.index("BroadcastHashJoin"):]
    assert "Exchange hashpartitioning" not in scan_to_join


def test_labelled_pairs_are_not_joined(spark):
    """Labels are joined to lines: above the expansion into pairs stands no join, and lines are moved by order once."""
    m = Market(spark, SF)
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        plan = plan_of(dimensions.product_affinity(m.order_items(), m.products()))
    above, below = plan[:plan.index("Generate explode")], plan[plan.index("Generate explode"):]
    assert "Join" not in above
    assert len(re.findall(r"Exchange hashpartitioning\(order_id", below)) == 1


def test_checks_scan_only_what_they_check(spark):
    from souklens.workload import QUERIES
    for name in ("check_row_counts", "check_referential", "check_unique_keys"):
        plan = plan_of(QUERIES[name](spark, SF))
        assert "c_nationkey" not in plan and "n_name" not in plan
    assert "Join" not in plan_of(QUERIES["check_row_counts"](spark, SF))
    assert "c_nationkey" not in plan_of(QUERIES["join_left_equi"](spark, SF)).split("o_orderkey")[-1]


def test_cohorts_are_reduced_before_the_roll_up(spark):
    m = Market(spark, SF)
    cohort = facts.sub_cohort(facts.user_subscription(m.users(), m.subscriptions(), m.tiers(), m.tier_pricing()), F.current_timestamp())
    plan = plan_of(reports.cohort_retention(cohort))
    expand, first_join = plan.index("Expand"), plan.index("Join")
    assert "HashAggregate" in plan[expand:first_join]


def test_cube_quantiles_spread_counts(spark):
    rows = Market(spark, SF).raw("lineitem")
    plan = plan_of(quantiles.exact_quantiles(rows, [], "cast(l_quantity as bigint)", {"m": 0.5}, 10, cube=["l_returnflag", "l_linestatus"]))
    spread = plan.index("Generate explode")
    assert "HashAggregate" in plan[spread:] and "FileScan" in plan[spread:]


def test_wide_values_with_widths_from_the_data(spark):
    """A range of 10^12 with a width of a thousandth of it: few buckets, few values in each."""
    df = spark.range(2000).select((F.pow(F.col("id") % 997, F.lit(4)) * 1000003).cast("long").alias("v"))
    width = df.agg(F.greatest(F.floor((F.max("v") - F.min("v")) / 1000), F.lit(1))).first()[0]
    values = sorted(r.v for r in df.collect())
    found = quantiles.exact_quantiles(df, [], "v", {"a": 0.25, "b": 0.5, "c": 0.999}, width).first()
    for name, p in (("a", 0.25), ("b", 0.5), ("c", 0.999)):
        at = p * (len(values) - 1)
        low, high = values[int(at)], values[min(int(at) + 1, len(values) - 1)]
        assert abs(found[name] - (low + (high - low) * (at - int(at)))) <= 1e-6 * max(1, abs(found[name]))


def test_centres_need_no_window(spark):
    from souklens.operators import moments
    cells = spark.range(10).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("x")).groupBy("g").agg(*moments.cell_moments("x", "x"))
    assert "Window" not in plan_of(moments.centred(cells, ["x"]))
