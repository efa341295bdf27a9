"""Exact quantiles without gathering a group in one task.

The built-in exact percentile keeps every distinct value of a group in one buffer, which does not
hold for a group with a large share of the data. Here rows are first counted per bucket of the value
range; tasks combine these counts before they are sent. The counts locate the buckets that hold the
wanted ranks, and only the rows of those buckets are moved, reduced to their distinct values, and
ranked, one bucket at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from souklens.operators.joins import null_safe
from souklens.session import written


def exact_quantiles(
    rows: DataFrame, keys: list[str], value: str, probs: dict[str, float], width: int | str, cube: list[str] | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles of whole numbers, one row per group.

    ``value`` and ``width`` are SQL expressions over ``rows``; rows without a value do not count.
    ``probs`` names the output columns. ``width`` is the number of values per bucket, constant within
    a group: it bounds the values ranked together, and the value range over ``width`` bounds the
    buckets ranked together: choose it from the data. ``rows`` is read twice, when the frame is built
    and when it is used, and must be a stored table: values that change in between give wrong results.

    With ``cube``, every combination of those keys is a grouping of its own: the column ``_g`` holds
    the grouping id and ``_q<key>`` the key, NULL where it is rolled up.

    The located buckets, at most two per group and quantile, are written, so that the join with
    them is a broadcast join only if they are small.
    """
    cube = cube or []
    group = [*(["_g"] if cube else []), *[f"_q{k}" for k in cube], *keys]
    valued = rows.selectExpr(*cube, *keys, f"cast({value} as bigint) AS value", f"{width} AS _w").filter(
        "value IS NOT NULL").selectExpr(*cube, *keys, "value", "cast(floor(value / cast(_w as double)) as bigint) AS bucket")

    per_bucket = valued.groupBy(*cube, *keys, "bucket").agg(F.expr("count(*) AS n"))
    if cube:
        per_bucket = _spread(per_bucket, cube, [*keys, "bucket", "n"]).groupBy(*group, "bucket").agg(F.expr("sum(n) AS n"))
    targets = written(_locate(per_bucket, group, probs), "quantile_buckets")

    near = valued
    if cube:
        # only rows of a bucket that some grouping wants, reduced to counts of values before they are spread
        wanted = targets.select(*[f"t{c}" for c in [*keys, "bucket"]]).distinct()
        near = near.join(wanted, null_safe([(F.col(c), F.col(f"t{c}")) for c in [*keys, "bucket"]]), "left_semi")
        near = near.groupBy(*cube, *keys, "bucket", "value").agg(F.expr("count(*) AS n"))
        near = _spread(near, cube, [*keys, "bucket", "value", "n"])
    else:
        near = near.withColumn("n", F.lit(1).cast("long"))
    match = null_safe([(F.col(c), F.col(f"t{c}")) for c in [*group, "bucket"]])
    near = near.join(targets, match).groupBy(*group, "bucket", "value").agg(
        F.expr("sum(n) AS n"), F.expr("any_value(before) AS before"), F.expr("any_value(wanted) AS wanted"))
    return _pick(near, group, list(probs))


def _spread(df: DataFrame, cube: list[str], rest: list[str]) -> DataFrame:
    """One row per grouping set: bit i (from the left) of ``_g`` rolls up the i-th key."""
    last = len(cube) - 1
    masked = [f"CASE WHEN (_g & {1 << last - i}) = 0 THEN {k} END AS _q{k}" for i, k in enumerate(cube)]
    return df.withColumn("_g", F.expr(f"explode(sequence(0, {(1 << len(cube)) - 1}))")).selectExpr("_g", *masked, *rest)


def _locate(per_bucket: DataFrame, group: list[str], probs: dict[str, float]) -> DataFrame:
    """Buckets that hold a wanted rank, with the number of values before them."""
    whole = Window.partitionBy(*group)
    upto = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = per_bucket.select(*group, "bucket", "n", F.sum("n").over(upto).alias("through"), F.sum("n").over(whole).alias("total"))
    ranks = ", ".join(f"struct('{name}' AS name, {float(p)}D * (total - 1) AS at)" for name, p in probs.items())
    # A quantile between two values needs the zero-based ranks floor(at) and floor(at) + 1, which
    # may lie in two buckets.
    wanted = f"filter(array({ranks}), r -> floor(r.at) < through AND floor(r.at) + 1 >= through - n) AS wanted"
    return placed.selectExpr(*[f"{c} AS t{c}" for c in [*group, "bucket"]], "through - n AS before", wanted).filter("size(wanted) > 0")


def _pick(near: DataFrame, group: list[str], names: list[str]) -> DataFrame:
    in_bucket = Window.partitionBy(*group, "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = near.select(*group, "value", "n", "wanted", (F.col("before") + F.sum("n").over(in_bucket)).alias("after"))
    hits = ranked.selectExpr(*group, "value", "after - n AS first", "after", "inline(wanted)")
    parts = []
    for i, name in enumerate(names):
        own = f"name = '{name}'"
        parts += [
            F.expr(f"max(CASE WHEN {own} AND floor(at) >= first AND floor(at) < after THEN value END) AS _lo{i}"),
            F.expr(f"max(CASE WHEN {own} AND floor(at) + 1 >= first AND floor(at) + 1 < after THEN value END) AS _hi{i}"),
            F.expr(f"max(CASE WHEN {own} THEN at - floor(at) END) AS _sh{i}")]
    return hits.groupBy(*group).agg(*parts).selectExpr(*group, *[
        f"_lo{i} + CASE WHEN _sh{i} > 0 THEN (_hi{i} - _lo{i}) * _sh{i} ELSE 0D END AS {name}" for i, name in enumerate(names)])
