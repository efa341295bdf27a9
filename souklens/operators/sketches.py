"""Quantiles and distinct counts of many groupings from mergeable sketches.

The exact operators read rows for every grouping. Here each finest cell is reduced once to a sketch of bounded size, inside
every task, and all coarser groupings, or stored days and months, merge sketches instead of rows. The cells can be written
and merged later with those of other loads.

Quantiles come from KLL sketches: with size ``k`` the rank of the value returned is off by less than ``rank_error(k)`` of the
rows of the grouping, with a probability of 0.99 for each answer, however often sketches were merged. Distinct counts
come from HyperLogLog sketches with ``2 ** bits`` cells, whose relative standard error is ``distinct_error(bits)``.
NULL values do not count. A grouping without values has the quantiles NULL and the count 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Size of a quantile sketch: ranks within 0.3 percent. Bits of a distinct sketch: a standard error of 0.8 percent.
QUANTILE_SIZE = 1_000
DISTINCT_BITS = 14


def rank_error(k: int = QUANTILE_SIZE) -> float:
    """Share of a grouping's rows by which the rank of a quantile is off at most, with probability 0.99."""
    return 2.296 / k ** 0.9723


def distinct_error(bits: int = DISTINCT_BITS) -> float:
    return 1.04 / 2 ** (bits / 2)


def quantile_cells(rows: DataFrame, keys: list[str], value: str, k: int = QUANTILE_SIZE) -> DataFrame:
    """A row for each finest cell of ``keys``: ``sketch`` and the number ``n`` of the whole-number expression ``value``."""
    number = F.expr(value).cast("bigint")
    return rows.groupBy(*keys).agg(F.kll_sketch_agg_bigint(number, F.lit(k)).alias("sketch"), F.count(number).alias("n"))


def distinct_cells(rows: DataFrame, keys: list[str], value: str, bits: int = DISTINCT_BITS) -> DataFrame:
    return rows.groupBy(*keys).agg(F.hll_sketch_agg(value, bits).alias("sketch"))


def merged_quantiles(cells: DataFrame, keys: list[str], probs: dict[str, float], cube: bool = False) -> DataFrame:
    """Quantiles of every grouping: of ``keys``, or with ``cube`` of every combination of them, where ``_g`` is the
    grouping id. Quantiles are values of the data, those at rank ``p`` times the number of rows."""
    grouped = cells.cube(*keys) if cube else cells.groupBy(*keys)
    merged = grouped.agg(F.kll_merge_agg_bigint("sketch").alias("sketch"), F.sum("n").alias("n"), *([F.grouping_id().alias("_g")] if cube else []))
    found = [F.when(F.col("n") > 0, F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(p)))).alias(name) for name, p in probs.items()]
    return merged.select(*keys, *(["_g"] if cube else []), "n", *found)


def merged_distinct(cells: DataFrame, keys: list[str], name: str, cube: bool = False) -> DataFrame:
    """The estimated distinct count of every grouping, as ``merged_quantiles``. The cells may be those of several loads."""
    grouped = cells.cube(*keys) if cube else cells.groupBy(*keys)
    merged = grouped.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(name), *([F.grouping_id().alias("_g")] if cube else []))
    return merged.select(*keys, *(["_g"] if cube else []), name)
