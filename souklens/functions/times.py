"""Dates and times. A "date" of the source model keeps its time of day, so it is a timestamp here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: ISO 8601 with an optional fraction of one to six digits and an offset or ``Z``.
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]XXX"


def parse_iso(text: Column) -> Column:
    """ISO text with an offset to a timestamp in the session zone (UTC); NULL when it is not one."""
    return F.try_to_timestamp(text, F.lit(ISO_FORMAT))


def as_timestamp(df: DataFrame, name: str) -> Column:
    """``name`` as a timestamp, parsed only when the frame still carries it as text."""
    column = F.col(name)
    return parse_iso(column) if df.schema[name].dataType.typeName() == "string" else column.cast("timestamp")


def date_of_text(text: Column) -> Column:
    """Calendar day of ISO text, read from its first ten characters; the zone is not applied."""
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd").cast("timestamp")


def second_of(ts: Column) -> Column:
    """Timestamp cut to whole seconds, the resolution of the source model's dates."""
    return F.date_trunc("SECOND", ts)


def month_of(ts: Column) -> Column:
    return F.date_trunc("MM", ts)


def day_of(ts: Column) -> Column:
    return F.date_trunc("DD", ts)


def month_in(df: DataFrame, name: str) -> Column:
    """First instant of the month of ``name``, which may be text or a timestamp."""
    if df.schema[name].dataType.typeName() == "string":
        return month_of(date_of_text(F.col(name)))
    return month_of(F.col(name))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Whole seconds from ``earlier`` to ``later``."""
    return F.unix_seconds(later) - F.unix_seconds(earlier)


def days_between(later: Column, earlier: Column) -> Column:
    """Days as a fractional number; ``datediff`` would drop the time of day."""
    return seconds_between(later, earlier) / F.lit(86400.0)


def plus_days(ts: Column, days: Column | int) -> Column:
    days = F.lit(days) if isinstance(days, int) else days
    return ts + F.make_dt_interval(days.cast("int"))


def months_before(ts: Column, months: int) -> Column:
    """``months`` earlier, time of day kept; the last day of a month maps to the last day."""
    shifted = ts - F.make_ym_interval(F.lit(0), F.lit(months))
    month_end = F.last_day(shifted).cast("timestamp") + (ts - F.date_trunc("DD", ts))
    return F.when(F.dayofmonth(ts) == F.dayofmonth(F.last_day(ts)), month_end).otherwise(shifted)


def from_epoch_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms.cast("long"))


def year_month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def month_name(ts: Column) -> Column:
    return F.upper(F.date_format(ts, "MMM"))


def quarter_text(ts: Column) -> Column:
    return F.quarter(ts).cast("string")


def iso_text(ts: Column, micros: bool = False) -> Column:
    """UTC timestamp to ISO text with the offset ``+00:00``."""
    pattern = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS" if micros else "yyyy-MM-dd'T'HH:mm:ss"
    return F.concat(F.date_format(ts, pattern), F.lit("+00:00"))
