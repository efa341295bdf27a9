"""Joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from souklens.session import written


#: A header with more details than this is joined apart; up to here one task joins it easily.
SPLIT_ABOVE = 1_000_000


def detail_left_join(header: DataFrame, detail: DataFrame, header_key: str, detail_key: str, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """Left join of headers with their details, safe for a header with very many details.

    Adaptive execution can split a left join only on its preserved side, here the headers. Headers
    with very many details therefore go through an inner join, which can be split on the detail
    side; they have details, so the inner join loses none of them. All others go through a plain
    left join. Both joins take all rows of their keys, so the result does not depend on which keys
    are told apart; these are found by counting one in a hundred keys of details when a header must
    have a million to matter. This count runs when the frame is built. The list is written, so that Catalyst
    knows its size; mostly it is empty.

    Columns of the two frames must differ in name.
    """
    share = min(1.0, 10_000 / max(split_above, 1))
    seen = detail.select(F.col(detail_key).alias("_many")).filter("_many IS NOT NULL")
    seen = seen if share == 1.0 else seen.sample(share, seed=1)
    counts = seen.groupBy("_many").agg(F.count(F.lit(1)).alias("_n"))
    many = written(counts.filter(F.col("_n") > split_above * share).select("_many"), "many_details")
    same = F.col(header_key) == F.col(detail_key)
    if many.isEmpty():
        return header.join(detail, same, "left")

    def part(df: DataFrame, key: str, how: str) -> DataFrame:
        return df.join(many, F.col(key) == F.col("_many"), how)

    few = part(header, header_key, "left_anti").join(part(detail, detail_key, "left_anti"), same, "left")
    return few.unionByName(part(header, header_key, "left_semi").join(part(detail, detail_key, "left_semi"), same))


def valid_at(start: Column, end: Column, moment: Column) -> Column:
    """``moment`` lies in the half-open period from ``start`` to ``end``; a NULL end is open."""
    return (moment >= start) & (end.isNull() | (moment < end))


def null_safe(pairs: list[tuple[Column, Column]]) -> Column:
    """Equality of all pairs where NULL equals NULL."""
    return reduce(lambda a, b: a & b, [left.eqNullSafe(right) for left, right in pairs])


def latest_per_key(df: DataFrame, key: str, when: str, tie: str, keep: list[str]) -> DataFrame:
    """The newest row of each key; a NULL time counts as newest, as in a descending order.

    Written as an aggregate, so that each task first reduces its rows to one per key; a window
    would move every row of a key to the same task.
    """
    newest = F.struct(F.col(when).isNull().alias("_n"), F.col(when).alias("_w"), F.col(tie).alias("_t"),
                      *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)])
    best = df.groupBy(key).agg(F.max(newest).alias("_best"))
    return best.select(key, *[F.col(f"_best._{i}").alias(c) for i, c in enumerate(keep)])
