"""Rank and running total over a few large groups, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType

from souklens.operators.joins import null_safe
from souklens.session import written


#: Parts that the values of a long histogram are cut into, so that no task orders all values of a group.
PARTS = 200
#: Rows of a histogram that one task orders easily, and of a tie that one task numbers.
SHORT = 100_000
CELL_ROWS = 200_000


def tie_hash(*ids: str) -> Column:
    """Orders rows that tie in a value, evenly spread whatever the ids are.

    The hash is MD5 because other SQL systems can state it, so results can be compared.
    """
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ids]))


def _larger(histogram: DataFrame, group: str, value: str, amount: Column, name: str) -> DataFrame:
    """``_g``, ``_v`` and the sum of ``amount`` over the rows of the group with a larger value.

    The values of a long histogram are cut into parts of about equal size: sums of whole parts are added in one
    small window, values inside a part in a window of its own. A short one is ordered as it is. Counts the histogram, and
    for a long one looks for the bounds of the parts, when the frame is built.
    """
    held = histogram.select(F.col(group).alias("_g"), F.col(value).alias("_v"), amount.alias("_a"))
    if histogram.count() <= SHORT:
        before = Window.partitionBy("_g").orderBy(F.desc("_v")).rowsBetween(Window.unboundedPreceding, -1)
        return held.select("_g", "_v", F.coalesce(F.sum("_a").over(before), F.lit(0)).alias(name))
    found = histogram.agg(F.percentile_approx(value, [i / PARTS for i in range(1, PARTS)], 10 * PARTS)).first()[0]  # PARTS numbers
    bounds = F.array(*[F.lit(b) for b in dict.fromkeys(found or [])]).cast(ArrayType(histogram.schema[value].dataType))
    rows = held.withColumn("_part", F.size(F.filter(bounds, lambda b: b < F.col("_v"))))
    whole = Window.partitionBy("_g").orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_g", "_part").orderBy(F.desc("_v")).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_g", "_part").agg(F.sum("_a").alias("_a")).select(
        F.col("_g").alias("_pg"), F.col("_part").alias("_pp"), F.coalesce(F.sum("_a").over(whole), F.lit(0)).alias("_before"))
    placed = rows.withColumn("_inside", F.coalesce(F.sum("_a").over(inside), F.lit(0)))
    same = null_safe([(F.col("_g"), F.col("_pg"))]) & (F.col("_part") == F.col("_pp"))
    return placed.join(parts, same).select("_g", "_v", (F.col("_before") + F.col("_inside")).alias(name))


def rank_and_running_total(
    df: DataFrame, rank_by: str, total_by: str, value: str, ids: list[str], rank_as: str, running_as: str, digits: int | None = None,
) -> DataFrame:
    """Adds the rank by descending ``value`` within ``rank_by`` and the running total of ``value``
    within ``total_by`` in the order (value descending, hash of the ids, ids).

    Both follow from a histogram of (groups, value, first ``digits`` hex digits of the hash): the rank
    is one plus the rows with a larger value, the running total is that of the histogram rows before
    plus the position within the own cell. Only rows of one cell are ordered, so a value that most rows
    share spreads over 16 to the power of ``digits`` tasks. Unless given, ``digits`` follows from the histogram
    without hashes: as many as bring the largest tie to ``CELL_ROWS`` a cell; the result does not depend on it. Nor is a
    nearly unique value ordered in one task (see ``_larger``).

    The histogram is written when the frame is built: it is read several times, and its exact size
    decides whether it is broadcast. ``df`` is read twice, or three times if ties are split, and must be a stored
    table. ``value`` must not be NULL; a NULL group is a group. There are few groups of ``rank_by``.
    """
    cell = [total_by, value, "_bucket"]
    groups = list(dict.fromkeys([total_by, value, rank_by]))
    counted = F.count(F.lit(1)).alias("_n")
    whole = None
    if digits is None:
        whole = written(df.groupBy(*groups).agg(counted), "rank_values")
        largest = whole.groupBy(total_by, value).agg(F.sum("_n").alias("_n")).agg(F.max("_n")).first()[0] or 0
        digits = 0
        while largest > CELL_ROWS * 16 ** digits:
            digits += 1
    rows = df.withColumn("_hash", tie_hash(*ids)).withColumn("_bucket", F.substring("_hash", 1, digits) if digits else F.lit(""))
    if digits or whole is None:
        cells = written(rows.groupBy(*groups, "_bucket").agg(counted), "rank_cells")
    else:
        cells = whole.withColumn("_bucket", F.lit(""))

    n = F.sum("_n").alias("_n")
    ranks = _larger(cells.groupBy(rank_by, value).agg(n), rank_by, value, F.col("_n"), "_rank").withColumnsRenamed({"_g": "_rg", "_v": "_rv"})
    bases = _larger(cells.groupBy(total_by, value).agg(n), total_by, value, F.col("_n") * F.col(value), "_base").withColumnsRenamed({"_g": "_tg", "_v": "_tv"})

    ranked = cells.join(ranks, null_safe([(F.col(rank_by), F.col("_rg"))]) & (F.col(value) == F.col("_rv")))
    per_cell = ranked.groupBy(*cell).agg(n, F.collect_list(F.struct(F.col("_rg"), (F.col("_rank") + 1).alias("_rank"))).alias("_ranks"))
    in_tie = Window.partitionBy(total_by, value).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    skipped = per_cell.withColumn("_skip", F.coalesce(F.sum("_n").over(in_tie), F.lit(0)))
    offsets = skipped.join(bases, null_safe([(F.col(total_by), F.col("_tg"))]) & (F.col(value) == F.col("_tv"))).select(
        F.struct(*cell).alias("_cell"), "_skip", "_base", "_ranks")

    # As one struct the key is equal to itself also where a part is NULL. With the same type on both
    # sides the join takes over the partitioning of the window: the rows are moved once.
    position = F.row_number().over(Window.partitionBy("_cell").orderBy("_hash", *ids))
    placed = rows.withColumn("_cell", F.struct(*cell).cast(offsets.schema["_cell"].dataType)).withColumn("_at", position)
    running = F.col("_base") + (F.col("_skip") + F.col("_at")) * F.col(value)
    rank = F.filter("_ranks", lambda r: r["_rg"].eqNullSafe(F.col(rank_by)))[0]["_rank"]
    return placed.join(offsets, "_cell").select(*df.columns, rank.alias(rank_as), running.alias(running_as))


def newest_rows(df: DataFrame, when: str, tie: str, count: int) -> DataFrame:
    """The ``count`` newest rows. Rows older than the day that completes the count are dropped by
    a filter first, so tasks do not each keep and send ``count`` candidates."""
    day = F.to_date(F.substring(F.col(when), 1, 10)) if df.schema[when].dataType.typeName() == "string" else F.to_date(when)
    days = df.groupBy(day.alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    newer = Window.orderBy(F.desc_nulls_first("_day")).rowsBetween(Window.unboundedPreceding, -1)
    needed = days.withColumn("_before", F.coalesce(F.sum("_n").over(newer), F.lit(0))).filter(F.col("_before") < count)
    # When every day is needed, the filter keeps all rows, also those without a time.
    cut = needed.agg(F.min("_day").alias("_cut")).scalar()
    return df.filter(day.isNull() | (day >= cut)).orderBy(F.desc_nulls_first(when), F.asc(tie)).limit(count)


def page(df: DataFrame, order: list[Column], size: int, number: int = 0) -> DataFrame:
    """Page ``number`` (from zero) of an ordered result. The order must be unique."""
    return df.orderBy(*order).offset(size * number).limit(size)


def page_after(df: DataFrame, key: str, last: Column | None, size: int) -> DataFrame:
    """The page that follows the row with key ``last``: deep pages cost no more than the first."""
    rest = df if last is None else df.filter(F.col(key) > last)
    return rest.orderBy(key).limit(size)
