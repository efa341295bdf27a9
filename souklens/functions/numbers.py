"""Money, ratios and statistics with the NULL and rounding rules of the source model.

Ratios are divided as decimals, so a result that lies half way between two rounded values
goes away from zero, as exact arithmetic does. Binary floating point would not guarantee it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def nvl(value: Column, default) -> Column:
    return F.coalesce(value, F.lit(default))


def exact(value: Column, precision: int = 18, scale: int = 0) -> Column:
    return value.cast(f"decimal({precision},{scale})")


def ratio(numerator: Column, denominator: Column, digits: int = 2) -> Column:
    """``numerator / denominator`` of whole numbers, rounded; NULL for a zero denominator."""
    return F.round(exact(numerator) / F.nullif(exact(denominator), F.lit(0)), digits).cast("double")


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """``100 * part / whole`` of whole numbers, rounded; NULL for a zero whole."""
    return F.round(percent_raw(part, whole), digits).cast("double")


def percent_raw(part: Column, whole: Column) -> Column:
    return exact(part) * F.lit(100) / F.nullif(exact(whole), F.lit(0))


def flag(condition: Column) -> Column:
    """1 when the condition holds, otherwise 0, also for an unknown condition."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def sample_stddev(x: Column) -> Column:
    """Sample standard deviation; 0 for a single value, where Spark gives NULL."""
    return F.when(F.count(x) == 1, F.lit(0.0)).otherwise(F.stddev_samp(x))


def pearson(x: Column, y: Column) -> Column:
    """Correlation over the rows where both are present; NULL when either is constant.

    The built-in ``corr`` raises a division by zero on a constant column in ANSI mode. Constancy
    is tested by minimum and maximum, which is exact, rather than by a rounded deviation.
    """
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x).cast("double"), F.when(both, y).cast("double")
    varies = (F.min(px) < F.max(px)) & (F.min(py) < F.max(py))
    spread = F.nullif(F.stddev_pop(px) * F.stddev_pop(py), F.lit(0.0))
    return F.when(varies, F.covar_pop(px, py) / spread)


def mean_amount(total: Column, count: Column, digits: int = 2) -> Column:
    """Mean of amounts from their sum and number, rounded; NULL for no amounts."""
    return F.round(exact(total, 22, 2) / F.nullif(exact(count), F.lit(0)), digits)
