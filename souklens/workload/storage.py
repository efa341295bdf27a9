"""Sources and sinks: what is written to a store and read back must equal what it came from."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from souklens.functions.times import parse_iso
from souklens.operators import baskets
from souklens.plans import access
from souklens.session import new_path
from souklens.sources import delimited, documents, relational, schemas, storage
from souklens.sources.market import Market
from souklens.streaming import event_load
from souklens.workload.datasets import (
    BOUGHT_WITH_SQL, EVENTS_SQL, MKT_INVOICES_SQL, ORDERS_SQL, PRODUCTS_SQL, SELLERS_SQL, catalogue_documents,
    staged_events, staged_invoices, staged_order_items, staged_orders)
from souklens.workload.registry import query


@query("src_json_array", ORDERS_SQL, "orders_d")
def src_json_array(m: Market) -> DataFrame:
    """Files that hold JSON arrays."""
    path = new_path(m.spark, "array_files")
    staged_orders(m).write.text(path)
    return documents.rows_of_arrays(m.spark.read.text(path), schemas.ORDER, "value")


@query("src_json_nested", BOUGHT_WITH_SQL, "pairs", "products")
def src_json_nested(m: Market) -> DataFrame:
    """Result sets of positional rows, nested as the graph store returns them."""
    pairs = access.bought_with(m.order_items(), m.products())
    row = F.concat(F.lit("["), F.concat_ws(",", *[F.to_json(F.array(F.col(c).cast("string"))) for c in pairs.columns]), F.lit("]"))
    flat = F.regexp_replace(row, r'"\],\["', '","')
    document = F.concat(F.lit('{"data": {"values": '), flat, F.lit("}}"))
    path = new_path(m.spark, "result_sets")
    pairs.select(document.alias("value")).write.text(path)
    positions = {**documents.PAIR_POSITIONS, "product_1_id": "long", "product_2_id": "long"}
    return documents.rows_of_result_set(m.spark.read.text(path), positions, "value")


@query("src_jdbc_orders", """
    SELECT o_orderkey AS id, o_custkey AS user_id, o_orderstatus AS status, o_totalprice AS total FROM orders""")
def src_jdbc_orders(m: Market) -> DataFrame:
    """The file drop of a relational table, reduced to the wanted columns."""
    rows = relational.read_drop(m.spark, f"{m.path}/orders.parquet", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"])
    return rows.toDF("id", "user_id", "status", "total")


@query("src_events", """
    SELECT id, user_id, event_type, product_id, occurred_at FROM events_d WHERE occurred_at >= TIMESTAMP '2000-06-15 12:00:00'""", "events_d")
def src_events(m: Market) -> DataFrame:
    """A time range of the partitioned event store; earlier chunks are not read."""
    path = new_path(m.spark, "event_store")
    storage.write_by_time(m.events(), path, chunk="MONTH")
    start = F.lit("2000-06-15 12:00:00").cast("timestamp")
    return storage.read_since(m.spark, path, start, chunk="MONTH").select("id", "user_id", "event_type", "product_id", "occurred_at")


@query("src_csv_external", SELLERS_SQL, "sellers")
def src_csv_external(m: Market) -> DataFrame:
    path = new_path(m.spark, "external_csv")
    delimited.write_csv(m.sellers(), path)
    return delimited.read_external(m.spark, path, schemas.SELLER_PROFILE)


@query("src_csv_external_rejects", """
    SELECT CAST(s_suppkey AS VARCHAR) AS user_id, CASE WHEN s_suppkey % 4 <> 2 THEN s_name END AS display_name, CASE s_suppkey % 4 WHEN 1 THEN s_suppkey || ',' || s_name || ',x' WHEN 2 THEN CAST(s_suppkey AS VARCHAR) END AS record
    FROM supplier""")
def src_csv_external_rejects(m: Market) -> DataFrame:
    """A quarter of the rows has a field too many, a quarter one too few: read all the same, and returned as they stand."""
    path = new_path(m.spark, "ragged_csv")
    key, name, kind = F.col("s_suppkey").cast("string"), F.col("s_name"), F.col("s_suppkey") % 4
    line = F.when(kind == 1, F.concat_ws(",", key, name, F.lit("x"))).when(kind == 2, key).otherwise(F.concat_ws(",", key, name))
    m.raw("supplier").select(line.alias("value")).write.option("lineSep", "\n").text(path)
    rows, rejects = delimited.read_external_rejects(m.spark, path, "user_id string, display_name string", header=False)
    records = rejects.select("record", F.split("record", ",")[0].alias("_key"))
    known = rows.join(records, F.col("user_id") == F.col("_key"), "left").drop("_key")
    return known


@query("src_csv_copy", """
    SELECT CAST(id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_id, event_type, CAST(product_id AS VARCHAR) AS product_id,
        CASE WHEN id % 3 = 0 THEN '' ELSE session_id END AS session_id, 'line "1",' || chr(10) || metadata AS metadata,
        occurred_at FROM events_d""", "events_d")
def src_csv_copy(m: Market) -> DataFrame:
    """Bulk load: a missing product stays NULL, an empty session an empty text, a line break a line break."""
    path = new_path(m.spark, "copy_csv")
    empty = F.when(F.col("id") % 3 == 0, F.lit("")).otherwise(F.col("session_id"))
    rows = m.events().withColumn("session_id", empty).select(
        "id", "user_id", "event_type", "product_id", "session_id", F.concat(F.lit('line "1",\n'), "metadata").alias("metadata"), "occurred_at")
    delimited.write_csv(rows, path)
    return delimited.read_copy(m.spark, path, schemas.EVENT_CSV)


@query("src_documents", PRODUCTS_SQL, "products")
def src_documents(m: Market) -> DataFrame:
    """Catalogue documents, one per line."""
    path = new_path(m.spark, "catalogue")
    catalogue_documents(m).write.json(path)
    return access.typed_products(documents.read_document_lines(m.spark, path, schemas.PRODUCT))


@query("src_graph_edges", "SELECT order_id, product_id FROM basket", "basket")
def src_graph_edges(m: Market) -> DataFrame:
    return baskets.contains_edges(m.order_items(), m.products())


@query("snk_staging", MKT_INVOICES_SQL, "mkt_invoices")
def snk_staging(m: Market) -> DataFrame:
    """Documents staged twice: the second load replaces the first."""
    path = new_path(m.spark, "staging")
    storage.replace_staging(staged_orders(m), path)
    storage.replace_staging(staged_invoices(m), path)
    return access.marketplace_invoices(m.spark.read.parquet(path).filter(F.col("loaded_at").isNotNull()))


@query("snk_materialize", """
    SELECT id, CAST(order_id AS VARCHAR) AS order_id, CAST(product_id AS VARCHAR) AS product_id, quantity,
        CAST(unit_price_usd AS DOUBLE) AS unit_price_usd, CAST(line_total_usd AS DOUBLE) AS line_total_usd FROM order_items""", "order_items")
def snk_materialize(m: Market) -> DataFrame:
    """A refreshed copy: the second refresh replaces the first, which held other rows."""
    copy = storage.MaterializedCopy(m.spark, new_path(m.spark, "copies"))
    rows = access.order_items(staged_order_items(m))
    copy.refresh(rows.withColumn("quantity", F.lit(-1)))
    copy.refresh(rows)
    return copy.current()


@query("snk_time_partitioned", """
    SELECT id, user_id, event_type, occurred_at, date_trunc('month', occurred_at) AS event_date FROM events_d""", "events_d")
def snk_time_partitioned(m: Market) -> DataFrame:
    path = new_path(m.spark, "by_month")
    storage.write_by_time(m.events(), path, chunk="MONTH")
    return storage.read_events(m.spark, path).select("id", "user_id", "event_type", "occurred_at", "event_date")


@query("snk_event_stream", EVENTS_SQL.replace("strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS occurred_at", "occurred_at"), "events_d")
def snk_event_stream(m: Market) -> DataFrame:
    """One store, half of it loaded in a batch and half by a stream of event documents."""
    drops, store, state = (new_path(m.spark, name) for name in ("event_drops", "event_table", "event_state"))
    rows = access.events(staged_events(m))
    streamed = F.crc32(F.encode("id", "UTF-8")) % 2 == 0
    rows.filter(streamed).write.json(drops)
    half = rows.filter(~streamed).withColumn("occurred_at", parse_iso(F.col("occurred_at")))
    storage.write_by_time(half, store, chunk="MONTH")
    event_load.load(m.spark, drops, store, state, chunk="MONTH").awaitTermination()
    return storage.read_events(m.spark, store).drop("event_date")


@query("snk_event_stream_unique", """
    WITH d AS (SELECT *, id % 3 <> 0 AS first_run FROM events_d),
    w AS (SELECT max(occurred_at) FILTER (first_run) - to_days(700) AS watermark FROM d)
    SELECT CAST(id AS VARCHAR) AS id, event_type, occurred_at, NOT first_run AND occurred_at <= watermark AS late
    FROM d, w""", "events_d")
def snk_event_stream_unique(m: Market) -> DataFrame:
    """Two runs of one stream, the second with all events of the first and others: each is stored once, those behind
    the watermark of the first run are late."""
    drops, store, state = (new_path(m.spark, name) for name in ("unique_drops", "unique_table", "unique_state"))
    rows = access.events(staged_events(m)).repartition(3)
    first = F.col("id") % 3 != 0
    load = lambda: event_load.load_unique(m.spark, drops, store, state, "700 days", chunk="MONTH").awaitTermination()
    rows.where(first).unionByName(rows.where(first & (F.col("id") % 2 == 0))).write.json(drops)
    load()
    rows.write.mode("append").json(drops)
    load()
    typed = rows.withColumn("occurred_at", parse_iso(F.col("occurred_at")))
    stored = storage.read_events(m.spark, store).select(*typed.columns, F.lit(False).alias("late"))
    both = stored.unionByName(event_load.not_stored(typed, store).withColumn("late", F.lit(True)))
    return both.select("id", "event_type", "occurred_at", "late")


@query("snk_event_store_compacted", """
    SELECT id, user_id, event_type, occurred_at, date_trunc('month', occurred_at) AS event_date, 1 AS most_files FROM events_d""", "events_d")
def snk_event_store_compacted(m: Market) -> DataFrame:
    """Five loads, compacted after three and again after all, one load repeated: each row once, one file a chunk."""
    path = new_path(m.spark, "compacted_table")
    for part in range(5):
        storage.add_load(m.events().where(F.col("id") % 5 == part), path, f"load-{part}", chunk="MONTH")
        if part in (2, 4):
            storage.compact(m.spark, path)
    storage.add_load(m.events().where(F.col("id") % 5 == 1), path, "load-1", chunk="MONTH")
    storage.vacuum(m.spark, path)
    rows = storage.read_events(m.spark, path).select("id", "user_id", "event_type", "occurred_at", "event_date", F.input_file_name().alias("file"))
    files = rows.groupBy("event_date").agg(F.countDistinct("file").alias("n")).agg(F.max("n").cast("int")).scalar()
    return rows.drop("file").withColumn("most_files", files)


def catalogue_text(m: Market) -> DataFrame:
    """The catalogue as imported from CSV: every field is text, attributes hold JSON, some broken."""
    attributes = F.concat(F.lit('{"brand": "'), F.col("description"), F.lit('", "colours": ["black", "red"]}'))
    broken = F.when(F.col("product_id") % 7 == 0, F.concat(attributes, F.lit("]"))).when(F.col("product_id") % 11 == 0, F.lit(None)).otherwise(attributes)
    def iso(c):
        return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return m.products().select(
        F.col("product_id").cast("string").alias("id"), F.col("price_usd").cast("string").alias("price_usd"),
        F.initcap(F.col("is_active").cast("string")).alias("is_active"), broken.alias("attributes"),
        iso("created_at").alias("created_at"), iso("updated_at").alias("updated_at"))


_ATTRIBUTES = """CASE WHEN product_id % 7 = 0 THEN 'broken' WHEN product_id % 11 = 0 THEN 'none' ELSE 'parsed' END"""


@query("doc_attributes_parse", f"""
    SELECT CAST(product_id AS VARCHAR) AS id, CASE WHEN {_ATTRIBUTES} = 'parsed' THEN description END AS brand,
        CASE WHEN {_ATTRIBUTES} = 'parsed' THEN 'red' END AS second_colour, {_ATTRIBUTES} = 'broken' AS kept_as_text FROM products""", "products")
def doc_attributes_parse(m: Market) -> DataFrame:
    parsed = documents.parse_attributes(catalogue_text(m))
    return parsed.select(
        "id", F.try_variant_get("attributes", "$.brand", "string").alias("brand"),
        F.try_variant_get("attributes", "$.colours[1]", "string").alias("second_colour"),
        F.col("attributes_text").isNotNull().alias("kept_as_text"))


@query("doc_scalar_types", """
    SELECT CAST(product_id AS VARCHAR) AS id, CAST(price_usd AS DOUBLE) AS price_usd, is_active, created_at, updated_at FROM products""", "products")
def doc_scalar_types(m: Market) -> DataFrame:
    return documents.type_scalars(catalogue_text(m)).select("id", "price_usd", "is_active", "created_at", "updated_at")
