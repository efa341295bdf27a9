"""Sketches, interval joins, stored pair counts, stored pages and SQL functions against plain results."""

import datetime as dt
import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from souklens.functions.sql import register_functions
from souklens.operators import intervals, pages, sketches
from souklens.session import new_path
from souklens.sources.market import Market
from souklens.sources.pair_store import PairStore
from souklens.workload.published import CATALOG

SMALL = "/root/testdata/sf0.001"


def test_quantile_sketches_of_all_groupings(spark):
    """Ranks within the bound, also after cells of two loads are merged; NULL values, NULL keys, ties, empty tables."""
    random_ = random.Random(1)
    rows = [(random_.choice(["a", "b", "c", None]), random_.randint(1, 3), int(random_.paretovariate(1.1) * 100) if random_.random() > 0.02 else None) for _ in range(60_000)]
    rows += [("a", 1, 7)] * 30_000 + [("z", 9, None)]
    df = spark.createDataFrame(rows, "k string, y int, v long")
    parts = df.randomSplit([0.4, 0.6], seed=3)
    cells = sketches.quantile_cells(parts[0], ["k", "y"], "v").unionByName(sketches.quantile_cells(parts[1], ["k", "y"], "v"))
    probs = {"q0": 0.0, "q10": 0.1, "q50": 0.5, "q99": 0.99, "q100": 1.0}
    for r in sketches.merged_quantiles(cells, ["k", "y"], probs, cube=True).collect():
        own = sorted(v for k, y, v in rows if v is not None and (r["_g"] >= 2 or k == r["k"]) and (r["_g"] % 2 or y == r["y"]))
        assert r["n"] == len(own)
        for name, p in probs.items():
            if not own:
                assert r[name] is None
                continue
            below, upto = sum(v < r[name] for v in own) / len(own), sum(v <= r[name] for v in own) / len(own)
            assert below <= p + 3 * sketches.rank_error() and upto >= p - 3 * sketches.rank_error()
    assert sketches.merged_quantiles(cells.limit(0), ["k"], probs).collect() == []


def test_distinct_sketches_of_stored_months(spark):
    random_ = random.Random(2)
    rows = [(f"t{random_.randint(0, 2)}", 2000 + random_.randint(0, 1), random_.randint(1, 12), random_.randint(0, 40_000)) for _ in range(60_000)] + [("t0", 2000, 1, None)]
    cells = sketches.distinct_cells(spark.createDataFrame(rows, "tier string, y int, m int, user long"), ["tier", "y", "m"], "user")
    for r in sketches.merged_distinct(cells, ["tier", "y"], "about", cube=True).collect():
        exact = len({u for t, y, _, u in rows if u is not None and (r["_g"] >= 2 or t == r["tier"]) and (r["_g"] % 2 or y == r["y"])})
        assert abs(r["about"] - exact) <= 4 * sketches.distinct_error() * exact


def test_interval_join_equals_range_join(spark):
    random_ = random.Random(4)
    when = lambda h: dt.datetime(2000, 1, 1) + dt.timedelta(hours=h)
    periods = []
    for i in range(400):
        begin = random_.randint(-500, 3_000)
        end = None if i % 40 == 0 else begin + random_.choice([0, -5, 1, 24, 24, 700, 5_000])
        periods.append((i, random_.choice(["hot", "a", "b", None]), when(begin), None if end is None else when(end)))
    periods.append((900, "a", None, when(5)))
    rows = [(i, random_.choice(["hot"] * 5 + ["a", "c", None]), when(random_.randint(-10, 2_500)) if i % 50 else None) for i in range(1_500)]
    left = spark.createDataFrame(rows, "id long, k string, at timestamp")
    right = spark.createDataFrame(periods, "no long, pk string, since timestamp, until timestamp")
    pairs = [(i, no) for i, k, at in rows for no, pk, since, until in periods if k is not None and k == pk and at is not None and since is not None and at >= since and (until is None or at < until)]
    without = [(i, None) for i, *_ in rows if i not in {i for i, _ in pairs}]
    for bins in (1, 4, 50):
        join = lambda how: Counter((r["id"], r["no"]) for r in intervals.valid_at_join(left, right, "k", "at", "pk", "since", "until", how, bins).collect())
        assert join("inner") == Counter(pairs) and join("left") == Counter(pairs + without)
    assert intervals.valid_at_join(left, right.limit(0), "k", "at", "pk", "since", "until").count() == len(rows)
    assert intervals.valid_at_join(left.limit(0), right, "k", "at", "pk", "since", "until").collect() == []
    with pytest.raises(ValueError):
        intervals.valid_at_join(left, right, "k", "at", "pk", "since", "until", "full")


def test_interval_join_meets_few_periods(spark):
    """A key with very many periods: copies stay bounded, and a row is compared with the periods of its bin."""
    hours = F.col("id").cast("int")
    periods = spark.range(20_000).select(F.col("id").alias("no"), F.lit("k").alias("pk"), (F.lit("2000-01-01").cast("timestamp") + F.make_dt_interval(hours=hours)).alias("since"),
                                         (F.lit("2000-01-01").cast("timestamp") + F.make_dt_interval(hours=hours + 1)).alias("until"))
    left = periods.select(F.col("no").alias("id"), F.lit("k").alias("k"), (F.col("since") + F.expr("INTERVAL 30 MINUTES")).alias("at"))
    joined = intervals.valid_at_join(left, periods, "k", "at", "pk", "since", "until")
    assert joined.where("id = no").count() == 20_000 == joined.count()
    seen = []
    kept, intervals.written = intervals.written, lambda df, name: seen.append(kept(df, name)) or seen[-1]
    try:
        intervals.valid_at_join(left, periods, "k", "at", "pk", "since", "until")
    finally:
        intervals.written = kept
    copies = seen[0].groupBy("_bin").count().agg(F.sum("count"), F.max("count")).first()
    assert copies[0] <= 20_000 * (intervals.BINS_EACH + 2) and copies[1] <= 3


def test_pair_store(spark):
    random_ = random.Random(6)
    lines = [(o, random_.randint(1, 15)) for o in range(90) for _ in range(random_.randint(1, 6))] + [(None, 3)]
    products = spark.createDataFrame([(p,) for p in range(1, 14)], "product_id long")

    def plain(orders):
        baskets = {o: {p for x, p in lines if x == o and p < 14} for o in orders}
        return Counter(pair for b in baskets.values() for pair in itertools.combinations(sorted(b), 2))

    def part(orders):
        return spark.createDataFrame([r for r in lines if r[0] in orders], "order_id long, product_id long")

    store = PairStore(spark, new_path(spark, "pairs"))
    stored = lambda: Counter({(r[0], r[1]): r[2] for r in store.pairs().collect()})
    assert stored() == {}
    store.add(part(range(30)), products)
    store.add(part(range(20, 60)), products)  # ten of them again
    assert stored() == plain(range(60))
    store.compact()
    store.compact()
    assert stored() == plain(range(60)) and len(store._loads()) == 1
    store.add(part([]), products)
    kept, store._commit = store._commit, lambda *a: 1 / 0  # a load that dies counts nothing
    with pytest.raises(ZeroDivisionError):
        store.add(part(range(60, 90)), products)
    store._commit = kept
    assert stored() == plain(range(60))
    store.add(part(range(90)), products)
    store.add(part(range(90)), products)
    assert stored() == plain(range(90))


@pytest.mark.parametrize("name", ["engagement-revenue", "geo-density", "sub-cohort"])
def test_pages_joined_are_the_ordered_result(spark, name):
    published, market = CATALOG[name], Market(spark, SMALL)
    frame = published.build(market)
    stored = pages.PagedResult(spark, new_path(spark, "pages"), published.order)
    whole = [tuple(r) for r in frame.orderBy(*stored._columns(frame)).collect()]
    stored.build(frame)
    size = max(7, len(whole) // 6)
    joined = [tuple(r) for n in range(math.ceil(len(whole) / size)) for r in stored.page(n, size).collect()]
    assert joined == whole and stored.page(10_000, size).collect() == []


def test_pages_of_few_rows_and_many_parts(spark):
    rows = spark.range(1_000).select((F.col("id") % 7).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("b"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    try:
        stored = pages.PagedResult(spark, new_path(spark, "pages"), (("a", "desc"), ("b", "asc_nulls_last"))).build(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = [tuple(r) for r in rows.orderBy(F.desc("a"), F.asc_nulls_last("b")).collect()]
    assert [tuple(r) for n in range(12) for r in stored.page(n, 90).collect()] == want
    assert len(stored.spans(100, 190)) >= 2  # a page over several parts
    assert pages.PagedResult(spark, new_path(spark, "pages"), (("a", "desc"),)).build(rows.limit(0)).page(0).collect() == []


def test_sql_functions(spark):
    register_functions(spark, my_rows="a int, b string")
    rows = spark.sql("""SELECT x, r.a, r.b FROM VALUES ('p', '[{"a": 1, "b": {"c": 2}}, {"a": "z"}]'), ('q', '[]'), ('r', NULL) AS t(x, doc), LATERAL my_rows(t.doc) r""")
    assert sorted(map(tuple, rows.collect()), key=str) == [("p", 1, '{"c":2}'), ("p", None, None)]
    pairs = spark.sql("""SELECT * FROM json_pairs('{"data": {"values": [["1", "x", "2", "y", "3"], ["4", null, "5", "z", "many"]]}}')""")
    assert [tuple(r) for r in pairs.collect()] == [("1", "x", "2", "y", 3), ("4", None, "5", "z", None)]
    one = spark.sql("SELECT base64_to_uuid('AAECAwQFBgcICQoLDA0ODw=='), base64_to_uuid('AAAA'), base64_to_uuid('  '), base64_to_uuid('@'), base64_to_uuid(NULL), number_of_text('n/a'), boolean_of_text('TRUE')").first()
    assert tuple(one) == ("00010203-0405-0607-0809-0a0b0c0d0e0f", None, None, None, None, None, True)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
