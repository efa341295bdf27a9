"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from souklens.functions import numbers, texts, times
from souklens.sources.market import Market
from souklens.workload.registry import query
from souklens.workload.tables_sql import rounded

@query("fn_date_parts", """
    SELECT event_id, date_trunc('month', ts) AS month, date_trunc('day', ts) AS day, date_trunc('second', ts) AS second,
        CAST(year(ts) AS INTEGER) AS year_no, CAST(month(ts) AS INTEGER) AS month_no, strftime(ts, '%Y-%m') AS year_month,
        upper(strftime(ts, '%b')) AS month_name, CAST(quarter(ts) AS VARCHAR) AS quarter_no FROM events""")
def date_parts(m: Market) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return m.raw("events").select(
        "event_id", times.month_of(ts).alias("month"), times.day_of(ts).alias("day"), times.second_of(ts).alias("second"),
        F.year(ts).alias("year_no"), F.month(ts).alias("month_no"), times.year_month(ts).alias("year_month"),
        times.month_name(ts).alias("month_name"), times.quarter_text(ts).alias("quarter_no"))


@query("fn_iso_text", """
    SELECT event_id, date_trunc('second', ts) AS plain, ts AS with_fraction, date_trunc('second', ts) - INTERVAL 2 HOUR AS other_zone,
        date_trunc('second', ts) AS zulu, CAST(NULL AS TIMESTAMP) AS not_a_time, date_trunc('day', ts) AS day FROM events""")
def iso_text(m: Market) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    plain = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return m.raw("events").select(
        "event_id", times.parse_iso(F.concat(plain, F.lit("+00:00"))).alias("plain"),
        times.parse_iso(times.iso_text(ts, micros=True)).alias("with_fraction"),
        times.parse_iso(F.concat(plain, F.lit("+02:00"))).alias("other_zone"),
        times.parse_iso(F.concat(plain, F.lit("Z"))).alias("zulu"),
        times.parse_iso(F.concat(F.lit("no "), plain)).alias("not_a_time"),
        times.date_of_text(plain).alias("day"))


@query("fn_date_arithmetic", """
    SELECT id, CAST(date_diff('second', TIMESTAMP '1995-01-01', date_trunc('second', occurred_at)) AS DOUBLE) AS seconds,
        occurred_at + to_days(30) AS plus_30, date_trunc('millisecond', occurred_at) AS from_ms FROM events_d""", "events_d")
def date_arithmetic(m: Market) -> DataFrame:
    at = F.col("occurred_at")
    days = times.days_between(at, F.lit("1995-01-01 00:00:00").cast("timestamp"))
    return m.events().select("id", F.round(days * 86400).alias("seconds"), times.plus_days(at, 30).alias("plus_30"),
                             times.from_epoch_ms(F.unix_millis(at)).alias("from_ms"))


@query("fn_months_before", """
    SELECT o_orderkey, CASE WHEN o_orderdate = last_day(o_orderdate) THEN CAST(last_day(o_orderdate - to_months(6)) AS TIMESTAMP)
        ELSE o_orderdate - to_months(6) END AS six_months_before FROM orders""")
def months_before(m: Market) -> DataFrame:
    return m.raw("orders").select("o_orderkey", times.months_before(F.col("o_orderdate").cast("timestamp"), 6).alias("six_months_before"))


@query("fn_numbers", f"""
    SELECT id, coalesce(CASE WHEN quantity > 10 THEN quantity END, 0) AS filled, nullif(quantity, 1) AS not_one,
        {rounded('CAST(line_total_usd * 100 AS HUGEINT)', 'quantity', 0)} / 100.0 AS each,
        {rounded('CAST(line_total_usd * 100 AS HUGEINT)', '1000', 0)} AS tens,
        CASE quantity % 3 WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'two' END AS label, quantity * 2 + 1 - 3 AS sums
    FROM order_items""", "order_items")
def number_functions(m: Market) -> DataFrame:
    q, total = F.col("quantity"), F.col("line_total_usd")
    return m.order_items().select(
        "id", numbers.nvl(F.when(q > 10, q), 0).alias("filled"), F.nullif(q, F.lit(1)).alias("not_one"),
        numbers.mean_amount(total, q).alias("each"), F.round(total / 10).alias("tens"),
        F.when(q % 3 == 0, "zero").when(q % 3 == 1, "one").otherwise("two").alias("label"), (q * 2 + 1 - 3).alias("sums"))


@query("fn_texts", """
    SELECT s_suppkey, trim(s_name) AS trimmed, CAST(length(s_name) AS INTEGER) AS chars, substr(s_name, 3, 4) AS piece, lower(s_name) AS lowered,
        s_name || '-' || s_suppkey AS joined, s_name AS unquoted, CASE WHEN s_suppkey % 3 <> 0 THEN s_name END AS not_blank FROM supplier""")
def text_functions(m: Market) -> DataFrame:
    name = F.col("s_name")
    blank = F.when(F.col("s_suppkey") % 3 == 0, F.lit("  ")).otherwise(name)
    return m.raw("supplier").select(
        "s_suppkey", F.trim(F.concat(F.lit(" "), name, F.lit(" "))).alias("trimmed"), F.length(name).alias("chars"),
        F.substring(name, 3, 4).alias("piece"), F.lower(name).alias("lowered"),
        F.concat_ws("-", name, F.col("s_suppkey").cast("string")).alias("joined"),
        texts.strip_quotes(F.concat(F.lit('"'), name, F.lit('"'))).alias("unquoted"), texts.blank_to_null(blank).alias("not_blank"))


@query("fn_base64_to_uuid", """
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN
        substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) END AS uuid
    FROM (SELECT p_partkey, md5(p_name || p_partkey) AS h FROM part)""")
def base64_to_uuid(m: Market) -> DataFrame:
    """A quarter of the rows hold 16 bytes; the others are blank, not base64 or of another length."""
    raw = F.unhex(F.md5(F.concat("p_name", F.col("p_partkey").cast("string"))))
    kind = F.col("p_partkey") % 4
    text = F.when(kind == 0, F.base64(raw)).when(kind == 1, F.lit("  ")).when(kind == 2, F.lit("@@@")).otherwise(F.lit("AAAA"))
    return m.raw("part").select("p_partkey", texts.base64_to_uuid(text).alias("uuid"))


@query("fn_text_to_scalar", """
    SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS price, p_size > 5 AS active FROM part""")
def text_to_scalar(m: Market) -> DataFrame:
    price = F.when(F.col("p_partkey") % 5 == 0, F.lit("n/a")).otherwise(F.col("p_retailprice").cast("string"))
    flag = F.when(F.col("p_size") > 5, F.lit("True")).otherwise(F.lit("False"))
    return m.raw("part").select("p_partkey", texts.number_of_text(price).alias("price"), texts.boolean_of_text(flag).alias("active"))


@query("fn_json_path", """
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_id % 3 <> 0 AS parses FROM events""")
def json_path(m: Market) -> DataFrame:
    broken = F.when(F.col("event_id") % 3 == 0, F.concat("props", F.lit("}"))).otherwise(F.col("props"))
    return m.raw("events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"),
                                  texts.json_or_null(broken).isNotNull().alias("parses"))
