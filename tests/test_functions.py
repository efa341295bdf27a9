from __future__ import annotations

import base64
import datetime as dt
import uuid

from pyspark.sql import functions as F

from souklens.functions import numbers, texts, times


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x"))
    return row.first()["x"]


def test_parse_iso_forms(spark):
    moment = dt.datetime(2024, 3, 5, 10, 0, 1)
    for text, expected in {
        "2024-03-05T10:00:01+00:00": moment,
        "2024-03-05T10:00:01Z": moment,
        "2024-03-05T12:00:01+02:00": moment,
        "2024-03-05T10:00:01.5+00:00": moment.replace(microsecond=500000),
        "2024-03-05T10:00:01.123456+00:00": moment.replace(microsecond=123456),
        "2024-03-05 10:00:01": None,
        "yesterday": None,
        "": None,
    }.items():
        assert one(spark, times.parse_iso(F.col("t")), t=text) == expected, text


def test_date_of_text_ignores_the_zone(spark):
    assert one(spark, times.date_of_text(F.col("t")), t="2024-03-05T23:30:00-05:00") == dt.datetime(2024, 3, 5)
    assert one(spark, times.date_of_text(F.col("t")), t="no date at all") is None


def test_months_before_keeps_time_and_month_end(spark):
    def before(text, n):
        return one(spark, times.months_before(F.col("t").cast("timestamp"), n), t=text)
    assert before("2024-08-31 10:30:00", 6) == dt.datetime(2024, 2, 29, 10, 30)
    assert before("2023-02-28 01:00:00", 1) == dt.datetime(2023, 1, 31, 1)
    assert before("2024-08-15 10:30:00", 24) == dt.datetime(2022, 8, 15, 10, 30)


def test_days_between_is_fractional(spark):
    days = times.days_between(F.lit("2024-01-02 12:00:00").cast("timestamp"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    assert spark.range(1).select(days.alias("d")).first()["d"] == 1.5


def test_base64_to_uuid(spark):
    key = uuid.uuid4()
    assert one(spark, texts.base64_to_uuid(F.col("t")), t=base64.b64encode(key.bytes).decode()) == str(key)
    for bad in ("", "   ", "@@@", "AAAA", base64.b64encode(b"x" * 17).decode()):
        assert one(spark, texts.base64_to_uuid(F.col("t")), t=bad) is None


def test_json_must_be_one_value(spark):
    good = ['{"a": 1}', "[1, 2]", "3", '"text"', "{}", " {} "]
    bad = ["", "{", '{"a": 1}}', "{} {}", "{}, {}", "1],[2", '1}, "b": {"c": 2', "a", "{},"]
    for text in good:
        assert one(spark, texts.json_or_null(F.col("t")).isNotNull(), t=text), text
    for text in bad:
        assert not one(spark, texts.json_or_null(F.col("t")).isNotNull(), t=text), text


def test_scalar_texts(spark):
    assert one(spark, texts.number_of_text(F.col("t")), t="12.5") == 12.5
    assert one(spark, texts.number_of_text(F.col("t")), t="n/a") is None
    assert one(spark, texts.boolean_of_text(F.col("t")), t="TRUE") is True
    assert one(spark, texts.boolean_of_text(F.col("t")), t="False") is False
    assert one(spark, texts.strip_quotes(F.col("t")), t='"a"b"') == 'a"b'
    assert one(spark, texts.blank_to_null(F.col("t")), t="  ") is None


def test_ratios_round_half_away_from_zero(spark):
    assert one(spark, numbers.percent(F.col("a"), F.col("b")), a=1, b=16000) == 0.01  # 0.00625
    assert one(spark, numbers.percent(F.col("a"), F.col("b")), a=-1, b=800) == -0.13  # -0.125
    assert one(spark, numbers.ratio(F.col("a"), F.col("b")), a=201, b=200) == 1.01  # 1.005
    assert one(spark, numbers.percent(F.col("a"), F.col("b")), a=1, b=0) is None


def test_statistics_guards(spark):
    df = spark.createDataFrame([("one", 5.0, 1.0), ("same", 2.0, 0.1), ("same", 2.0, 0.2), ("line", 1.0, 2.0), ("line", 2.0, 4.0),
                                ("line", None, 9.0), ("none", None, 1.0)], "g string, x double, y double")
    rows = {r.g: r for r in df.groupBy("g").agg(
        numbers.sample_stddev(F.col("x")).alias("sd"), numbers.pearson(F.col("x"), F.col("y")).alias("r")).collect()}
    assert rows["one"].sd == 0.0 and rows["one"].r is None
    assert rows["same"].sd == 0.0 and rows["same"].r is None
    assert abs(rows["line"].r - 1.0) < 1e-12
    assert rows["none"].sd is None and rows["none"].r is None
