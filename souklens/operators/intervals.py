"""Joins with periods of validity that do not compare a row with every period of its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from souklens.operators.joins import valid_at
from souklens.session import written

#: Bins that a period spans on average. More of them mean shorter bins: fewer periods in vain for each row, more copies.
BINS_EACH = 4


def valid_at_join(
    left: DataFrame, periods: DataFrame, left_key: str, moment: str, key: str, start: str, end: str, how: str = "left", bins_each: int = BINS_EACH,
) -> DataFrame:
    """Rows of ``left`` with every period of their key that holds at ``moment`` (from ``start`` on, before ``end``; a NULL
    end is open). ``how`` is "left" or "inner".

    Time is cut into bins of one width, a row meets only periods that reach into its bin: how many periods its key has does
    not matter, and a key that many rows share is spread over its bins, whose joins adaptive execution can split further on
    the side of the rows. Periods are cut to the range of the moments first. The width is the mean
    length of what is left over ``bins_each``, so there are at most ``bins_each`` + 1 copies of a period on average,
    whatever single ones are like. Range and width are told when the frame is built, from one scan of the moments and
    one of the periods. Periods that end before they start hold never. Overlapping periods yield a row each.

    Columns of the two frames must differ in name.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"how {how}")
    at = F.unix_micros(moment)
    low, high = left.agg(F.min(at), F.max(at)).first()
    if low is None:
        low, high = 0, 0
    begins = F.greatest(F.unix_micros(start), F.lit(low))
    ends = F.least(F.coalesce(F.unix_micros(end), F.lit(high + 1)), F.lit(high + 1))
    cut = periods.withColumns({"_from": begins, "_to": ends}).where(F.col(start).isNotNull() & F.col(key).isNotNull() & (F.col("_from") < F.col("_to")))
    total, n = cut.agg(F.sum((F.col("_to") - F.col("_from")).cast("decimal(38,0)")), F.count(F.lit(1))).first()
    width = max(1, int(total) // (n * bins_each)) if n else 1
    bin_of = lambda c: F.expr(f"{c} DIV {width}") if low >= 0 else F.floor(F.col(c) / F.lit(width).cast("decimal(20,0)")).cast("long")
    held = cut.withColumn("_last", F.col("_to") - 1)
    held = written(held.withColumn("_bin", F.explode(F.sequence(bin_of("_from"), bin_of("_last")))).drop("_from", "_to", "_last"), "period_bins")
    rows = left.withColumn("_at", at).withColumn("_row_bin", bin_of("_at"))
    match: Column = (F.col(left_key) == F.col(key)) & (F.col("_row_bin") == F.col("_bin")) & valid_at(F.col(start), F.col(end), F.col(moment))
    return rows.join(held, match, how).drop("_at", "_row_bin", "_bin")
