from __future__ import annotations

import datetime as dt
import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from souklens.operators import baskets, checks, joins, moments, quantiles, rankings
from souklens.plans import dimensions
from souklens.sources import documents


def as_set(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("split_above", [0, 100, 10_000])
def test_detail_left_join_equals_left_join(spark, split_above):
    header = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "k int, v string")
    detail = spark.createDataFrame([(1, i) for i in range(500)] + [(3, 7), (9, 1), (None, 5)], "dk int, n int")
    expected = header.join(detail, F.col("k") == F.col("dk"), "left")
    assert as_set(joins.detail_left_join(header, detail, "k", "dk", split_above).select(expected.columns)) == as_set(expected)


def test_valid_at_gaps_overlaps_and_open_end(spark):
    prices = spark.createDataFrame([("p", "2024-01-01", "2024-02-01", 1), ("p", "2024-01-15", "2024-03-01", 2), ("p", "2024-06-01", None, 3)],
                                   "t string, a string, b string, price int")
    sales = spark.createDataFrame([("p", "2024-01-10"), ("p", "2024-01-20"), ("p", "2024-02-01"), ("p", "2024-04-01"), ("p", "2025-01-01"), ("q", "2024-01-10")],
                                  "s string, at string")
    match = (F.col("s") == F.col("t")) & joins.valid_at(F.col("a").cast("timestamp"), F.col("b").cast("timestamp"), F.col("at").cast("timestamp"))
    found = Counter((r.s, r.at, r.price) for r in sales.join(prices, match, "left").collect())
    assert found == Counter([("p", "2024-01-10", 1), ("p", "2024-01-20", 1), ("p", "2024-01-20", 2), ("p", "2024-02-01", 2),
                             ("p", "2024-04-01", None), ("p", "2025-01-01", 3), ("q", "2024-01-10", None)])


def test_latest_per_key_takes_unknown_time_first(spark):
    rows = spark.createDataFrame([(1, "2024-01-01", 1, "old"), (1, "2024-02-01", 2, "new"), (2, "2024-01-01", 1, "dated"),
                                  (2, None, 2, "undated"), (3, "2024-01-01", 1, "low"), (3, "2024-01-01", 2, None)], "k int, at string, id int, v string")
    found = {r.k: r.v for r in joins.latest_per_key(rows, "k", "at", "id", ["v"]).collect()}
    assert found == {1: "new", 2: "undated", 3: None}


def brute_pairs(lines, known):
    orders: dict = {}
    for order, product in lines:
        if product in known:
            orders.setdefault(order, set()).add(product)
    return Counter(pair for basket in orders.values() for pair in itertools.combinations(sorted(basket), 2))


@pytest.mark.parametrize("split_above", [2, 5, 1000])
def test_pairs_against_brute_force(spark, split_above):
    rng = random.Random(split_above)
    lines = [(o, rng.randrange(40)) for o in range(60) for _ in range(rng.randrange(1, 6))]
    lines += [(999, rng.randrange(40)) for _ in range(len(lines) // 2)]  # one order holds a third of all lines
    lines += [(1000, 3), (1001, 4), (1001, 4)]  # one product, a repeated product
    known = set(range(35))
    items = spark.createDataFrame(lines, "order_id int, product_id int")
    products = spark.createDataFrame([(p,) for p in known], "product_id int")
    found = {(r.product_1_id, r.product_2_id): r.co_purchase_count for r in baskets.bought_with(items, products, split_above).collect()}
    assert found == dict(brute_pairs(lines, known))


def test_pair_counts_add_up_to_basket_sizes(spark):
    rng = random.Random(5)
    items = spark.createDataFrame([(o, rng.randrange(30)) for o in range(50) for _ in range(4)], "order_id int, product_id int")
    products = spark.range(30).select(F.col("id").alias("product_id"))
    sizes = baskets.contains_edges(items, products).groupBy("order_id").count()
    expected = sizes.agg(F.sum(F.expr("count * (count - 1) div 2"))).first()[0]
    assert baskets.bought_with(items, products).agg(F.sum("co_purchase_count")).first()[0] == expected


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_quantiles_against_numpy(spark, width):
    rng = random.Random(width)
    groups = {"wide": [rng.randrange(-5000, 5000) for _ in range(501)], "ties": [3] * 300 + [4] * 100, "one": [-17], "two": [1, 2],
              None: [rng.randrange(100) for _ in range(64)]}
    df = spark.createDataFrame([(g, v) for g, values in groups.items() for v in [*values, None]], "g string, v int")
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.66, "e": 0.99, "f": 1.0}
    found = quantiles.exact_quantiles(df, ["g"], "v", probs, width).collect()
    assert len(found) == len(groups)
    for row in found:
        for name, p in probs.items():
            assert abs(row[name] - np.quantile(groups[row.g], p)) < 1e-9, (row.g, name)


def test_cube_quantiles_against_numpy(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), rng.choice(["x", None]), rng.randrange(300)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a string, b string, v int")
    found = quantiles.exact_quantiles(df, [], "v", {"q": 0.4}, 20, cube=["a", "b"]).collect()
    assert len(found) == 4 + 2 + 2 + 1
    for r in found:
        part = [v for a, b, v in rows if (r._g & 2 or a == r._qa) and (r._g & 1 or b == r._qb)]
        assert abs(r.q - np.quantile(part, 0.4)) < 1e-9


@pytest.mark.parametrize("digits, short, cell", [(1, 100, 9), (3, 0, 9), (4, 0, 9), (None, 100, 1_000), (None, 0, 100), (None, 100, 3)])
def test_rank_and_running_total_against_brute_force(spark, monkeypatch, digits, short, cell):
    """Histograms in parts and whole, ties that fit a cell and ties that are split."""
    monkeypatch.setattr(rankings, "SHORT", short)
    monkeypatch.setattr(rankings, "CELL_ROWS", cell)
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["x", "y", None]), 1 if rng.random() < 0.6 else rng.randrange(1, 9), i, i * 7 % 11) for i in range(400)]
    df = spark.createDataFrame(rows, "r string, t string, v long, p long, q long")
    found = {row.p: row for row in rankings.rank_and_running_total(df, "r", "t", "v", ["p", "q"], "rank", "running", digits).collect()}

    def order(row):
        return (-row[2], hashlib.md5(f"{row[3]}|{row[4]}".encode()).hexdigest(), row[3], row[4])

    assert len(found) == len(rows)
    for group in ("x", "y", None):
        total = 0
        for row in sorted((x for x in rows if x[1] == group), key=order):
            total += row[2]
            assert found[row[3]].running == total
    for row in rows:
        assert found[row[3]]["rank"] == 1 + sum(x[2] > row[2] for x in rows if x[0] == row[0])


def test_rank_over_nearly_unique_values(spark, monkeypatch):
    monkeypatch.setattr(rankings, "SHORT", 1_000)
    rows = [("a" if i % 3 else "b", "x", (i * 7919) % 5003, i) for i in range(5000)]
    df = spark.createDataFrame(rows, "r string, t string, v long, p long")
    found = {row.p: row for row in rankings.rank_and_running_total(df, "r", "t", "v", ["p"], "rank", "running", 1).collect()}
    total, counts = 0, {"a": 0, "b": 0}
    for r, _, v, p in sorted(rows, key=lambda x: -x[2]):
        total, counts[r] = total + v, counts[r] + 1
        assert (found[p]["rank"], found[p].running) == (counts[r], total)


def test_labels_of_pairs_equal_a_join_of_pairs(spark):
    rng = random.Random(8)
    items = spark.createDataFrame([(o, rng.randrange(20)) for o in range(60) for _ in range(5)], "order_id int, product_id int")
    products = spark.createDataFrame([(p, rng.choice(["s", "t", None]), rng.choice(["u", "v"])) for p in range(18)], "product_id int, product_type string, seller_id string")
    plain = dimensions.product_affinity_type(baskets.bought_with(items, products), products)
    want = sorted(map(str, plain.collect()))
    for threshold in ("10MB", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            assert sorted(map(str, dimensions.product_affinity(items, products).collect())) == want
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_newest_rows_equals_sort_and_limit(spark):
    days = [(i, f"2024-01-{1 + i % 20:02d}T0{i % 10}:00:00+00:00" if i % 17 else None) for i in range(300)]
    df = spark.createDataFrame(days, "id int, at string")
    for count in (1, 30, 290, 1000):
        expected = df.orderBy(F.desc_nulls_first("at"), "id").limit(count)
        assert rankings.newest_rows(df, "at", "id", count).collect() == expected.collect()


def test_pages_cover_the_result_once(spark):
    df = spark.range(95)
    pages = [r.id for n in range(10) for r in rankings.page(df, [F.col("id")], 10, n).collect()]
    assert pages == list(range(95))
    assert [r.id for r in rankings.page_after(df, "id", F.lit(90), 10).collect()] == [91, 92, 93, 94]


def test_merged_moments_equal_direct_statistics(spark):
    rng = np.random.default_rng(3)
    rows = [(str(i % 3), str(i % 7), 1e6 + float(rng.normal()), float(rng.normal()) if i % 5 else None) for i in range(700)]
    rows += [("single", "z", 1e6, 2.0), ("flat", "u", 1e6 + 0.1, 1.0), ("flat", "v", 1e6 + 0.1, 2.0), ("flat", "v", 1e6 + 0.1, 3.0)]
    df = spark.createDataFrame(rows, "a string, b string, x double, y double")
    cells = df.groupBy("a", "b").agg(*moments.cell_moments("x", "x"), *moments.cell_comoments("xy", "x", "y"))
    cells = moments.centred(cells, ["x", "xy_x", "xy_y"])
    found = {r.a: r for r in cells.rollup("a").agg(F.expr(moments.merged_stddev("x")).alias("sd"), F.expr(moments.merged_pearson("xy")).alias("r")).collect()}
    for key in ("0", "1", "2", None):
        part = [(x, y) for a, _, x, y in rows if key is None or a == key]
        assert abs(found[key].sd / np.std([x for x, _ in part], ddof=1) - 1) < 1e-9
        both = [(x, y) for x, y in part if y is not None]
        assert abs(found[key].r - np.corrcoef(*zip(*both))[0, 1]) < 1e-9
    assert found["single"].sd == 0.0 and found["single"].r is None
    assert found["flat"].sd == 0.0 and found["flat"].r is None


def test_checks_on_broken_data(spark):
    child = spark.createDataFrame([(1, 1), (2, 1), (3, 9), (4, 9), (5, None)], "id int, parent int")
    parent = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id int")
    assert checks.referential({"l": (child, "parent", parent, "id")}).collect() == [("l", 2, 1)]
    assert checks.unique_keys({"p": (parent, "id")}).collect() == [("p", 1, 1)]
    assert checks.row_counts({"b": child, "a": parent}).collect() == [("a", 4), ("b", 5)]
    docs = spark.createDataFrame([("{}", True), ("{", False), (None, True)], "attributes string, is_active boolean")
    assert checks.document_counts(docs).collect() == [(3, 2, 1, 1)]
    assert {r.column_name: r.missing for r in checks.null_counts(child, ["id", "parent"]).collect()} == {"id": 0, "parent": 1}


def test_staged_documents_have_a_bounded_size(spark):
    staged = documents.stage_arrays(spark.range(0, 1001, 1, 3), per_document=100)
    sizes = [r.n for r in staged.select(F.json_array_length("json_doc").alias("n")).collect()]
    assert sum(sizes) == 1001 and max(sizes) <= 100


def test_newest_vertex_name_wins(spark):
    rows = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1)), (1, "b", dt.datetime(2024, 5, 1)), (2, "c", None)],
                                 "product_id int, name string, updated_at timestamp")
    assert as_set(baskets.product_vertices(rows)) == Counter([(1, "b"), (2, "c")])


def test_period_overlaps(spark):
    rows = [("none", "2024-01-01", "2024-02-01"), ("none", "2024-02-01", None), ("some", "2024-01-01", "2024-03-01"),
            ("some", "2024-02-01", "2024-02-10"), ("some", "2024-02-20", None), ("open", "2024-01-01", None), ("open", "2024-06-01", None)]
    df = spark.createDataFrame(rows, "k string, a string, b string")
    found = {r.k: (r.periods, r.overlapping) for r in checks.period_overlaps(df, "k", "a", "b").collect()}
    assert found == {"none": (2, 0), "some": (3, 2), "open": (2, 1)}
