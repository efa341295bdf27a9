"""Co-purchase pairs: which products share an order, and in how many orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from souklens.session import written

#: Baskets with more lines than this are split over many tasks.
SPLIT_ABOVE = 1000


def product_vertices(rows: DataFrame) -> DataFrame:
    """One vertex per product id; of several names the last updated one stays."""
    newest = F.struct("updated_at", "name")
    return rows.groupBy(F.col("product_id").alias("id")).agg(F.max(newest)["name"].alias("name"))


def order_vertices(items: DataFrame) -> DataFrame:
    return items.select(F.col("order_id").alias("id")).distinct()


def contains_lines(items: DataFrame, products: DataFrame, labels: tuple[str, ...] = ()) -> DataFrame:
    """Lines (order, product) whose product is in the catalogue, with ``labels`` of the product, whose id
    is unique; repeats are still present."""
    known = products.select(F.col("product_id").alias("_known"), *labels)
    lines = items.select("order_id", "product_id").join(known, F.col("product_id") == F.col("_known"), "inner" if labels else "left_semi")
    return lines.select("order_id", "product_id", *labels)


def contains_edges(items: DataFrame, products: DataFrame) -> DataFrame:
    """Distinct (order, product) edges."""
    return contains_lines(items, products).distinct()


def bought_with(items: DataFrame, products: DataFrame, split_above: int = SPLIT_ABOVE, labels: tuple[str, ...] = ()) -> DataFrame:
    """Every unordered product pair that shares an order, with the number of such orders, and for each
    of ``labels`` its values for both products (``product_1_<label>``, ``product_2_<label>``).

    Labels are joined to the lines and travel with them: pairs, of which there are many more, are not
    joined. Ordinary baskets are gathered, one row per order, and expanded in place: lines are moved
    once. Baskets with more than ``split_above`` lines, whatever their size, are split into blocks of
    about that many distinct products; each pair of blocks is a join key of its own, so a basket
    spreads over as many tasks as it has block pairs and each product pair arises in exactly one of
    them. Counting combines within each task before the shuffle.

    Which orders are large is told from a sample of lines in which such an order has about a hundred;
    one that is missed by chance is only a somewhat larger row. This, and writing the large baskets,
    runs when the frame is built; all else when it is used.
    """
    share = min(1.0, 100 / split_above)
    seen = items.select(F.col("order_id").alias("_large"))
    seen = seen if share == 1.0 else seen.sample(share, seed=1)
    sizes = seen.groupBy("_large").agg(F.count(F.lit(1)).alias("lines"))
    large = written(sizes.filter(F.col("lines") > split_above * share).select("_large"), "large_orders")
    lines = contains_lines(items, products, labels).select("order_id", F.struct("product_id", *labels).alias("product"))
    if large.isEmpty():
        pairs = _pairs_in_place(lines)
    else:
        is_large = F.col("order_id") == F.col("_large")
        edges = written(lines.join(large, is_large, "left_semi").distinct(), "large_baskets")
        pairs = _pairs_in_place(lines.join(large, is_large, "left_anti")).unionByName(_pairs_by_block(edges, split_above))
    sides = [F.any_value(f"p{side}.{label}").alias(f"product_{side}_{label}") for label in labels for side in (1, 2)]
    return pairs.groupBy(F.col("p1.product_id").alias("product_1_id"), F.col("p2.product_id").alias("product_2_id")).agg(
        F.count(F.lit(1)).alias("co_purchase_count"), *sides)


def _pairs_in_place(lines: DataFrame) -> DataFrame:
    baskets = lines.groupBy("order_id").agg(F.sort_array(F.collect_set("product")).alias("basket"))
    first = baskets.filter(F.size("basket") > 1).select("basket", F.posexplode("basket").alias("at", "p1"))
    later = F.slice("basket", F.col("at") + 2, F.size("basket"))
    return first.select("p1", F.explode(later).alias("p2"))


def _pairs_by_block(edges: DataFrame, block_size: int) -> DataFrame:
    blocks = edges.groupBy(F.col("order_id").alias("_order")).agg(
        F.ceil(F.count(F.lit(1)) / block_size).cast("int").alias("blocks"))
    cells = edges.join(blocks, F.col("order_id") == F.col("_order")).withColumn(
        "block", F.pmod(F.xxhash64("product.product_id"), F.col("blocks")).cast("int"))
    row = cells.select(F.col("order_id").alias("lo"), F.col("product").alias("lp"), F.col("block").alias("li"),
                       F.explode(F.sequence("block", F.col("blocks") - 1)).alias("lj"))
    column = cells.select(F.col("order_id").alias("ro"), F.col("product").alias("rp"), F.col("block").alias("rj"),
                          F.explode(F.sequence(F.lit(0), F.col("block"))).alias("ri"))
    same_cell = (F.col("lo") == F.col("ro")) & (F.col("li") == F.col("ri")) & (F.col("lj") == F.col("rj"))
    once = (F.col("li") < F.col("lj")) | (F.col("lp.product_id") < F.col("rp.product_id"))
    in_order = F.col("lp.product_id") < F.col("rp.product_id")
    return row.join(column, same_cell & once).select(
        F.when(in_order, F.col("lp")).otherwise(F.col("rp")).alias("p1"), F.when(in_order, F.col("rp")).otherwise(F.col("lp")).alias("p2"))
