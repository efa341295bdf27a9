"""Statistics of fine cells merged into coarser groups.

A cube over raw rows multiplies every row by the number of grouping sets. Here the rows are
reduced once to one row per finest cell, and only the cells are cubed. Deviations merge by their
distance to a common centre, which avoids the loss of digits of plain sums of squares; what is lost
is about 1e-16 times the squared distance of a group from the centre over the group's variance.

Arguments named x and y are SQL expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def cell_moments(name: str, x: str) -> list[Column]:
    """Aggregates that describe ``x`` in a cell."""
    x = f"cast({x} as double)"
    return [F.expr(f"{e} AS {name}_{part}") for part, e in {
        "n": f"count({x})", "mean": f"avg({x})", "m2": f"var_pop({x}) * count({x})", "min": f"min({x})", "max": f"max({x})"}.items()]


def cell_comoments(name: str, x: str, y: str) -> list[Column]:
    """Aggregates that describe the pairs of ``x`` and ``y`` in a cell where both are present."""
    px, py = f"CASE WHEN ({y}) IS NOT NULL THEN {x} END", f"CASE WHEN ({x}) IS NOT NULL THEN {y} END"
    both = f"covar_pop(cast({px} as double), cast({py} as double)) * count({px}) AS {name}_xy"
    return [*cell_moments(f"{name}_x", px), *cell_moments(f"{name}_y", py), F.expr(both)]


def centred(cells: DataFrame, names: list[str]) -> DataFrame:
    """Adds each cell mean's distance to the overall mean, a scalar subquery, which the merge needs."""
    centres = cells.agg(F.struct(*[F.expr(f"sum({name}_n * {name}_mean) / nullif(sum({name}_n), 0) AS {name}") for name in names])).scalar()
    return cells.select("*", *[(F.col(f"{name}_mean") - centres[name]).alias(f"{name}_d") for name in names])


def _m2(n: str, d: str, e: str, own: str) -> str:
    """Sum of products of deviations of the merged cells."""
    return f"(sum({own}) + sum({n} * {d} * {e}) - sum({n} * {d}) * sum({n} * {e}) / nullif(sum({n}), 0))"


def _varies(name: str) -> str:
    return f"min({name}_min) < max({name}_max)"


def merged_stddev(name: str) -> str:
    """Sample standard deviation of the merged cells: 0 for one value or equal values, NULL for none."""
    m2 = _m2(f"{name}_n", f"{name}_d", f"{name}_d", f"{name}_m2")
    spread = f"sqrt(greatest({m2}, 0D) / nullif(sum({name}_n) - 1, 0))"
    return f"CASE WHEN sum({name}_n) = 0 THEN NULL WHEN {_varies(name)} THEN {spread} ELSE 0D END"


def merged_pearson(name: str) -> str:
    """Correlation of the merged cells; NULL when a side is constant."""
    x, y = f"{name}_x", f"{name}_y"
    mx, my = (_m2(f"{s}_n", f"{s}_d", f"{s}_d", f"{s}_m2") for s in (x, y))
    spread = f"nullif(sqrt(greatest({mx}, 0D) * greatest({my}, 0D)), 0D)"
    return f"CASE WHEN {_varies(x)} AND {_varies(y)} THEN {_m2(f'{x}_n', f'{x}_d', f'{y}_d', f'{name}_xy')} / {spread} END"
