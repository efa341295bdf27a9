"""Published result sets: a dataset with a name and an order."""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from souklens.operators.rankings import page


@dataclass(frozen=True)
class Published:
    """``order`` lists columns with the name of a sort method, such as ``desc_nulls_last``."""

    build: Callable[..., DataFrame]
    order: tuple[tuple[str, str], ...] = ()

    def _order(self) -> list[Column]:
        return [getattr(F.col(name), direction)() for name, direction in self.order]

    def frame(self, source) -> DataFrame:
        rows = self.build(source)
        return rows.orderBy(*self._order()) if self.order else rows

    def page(self, source, number: int, size: int = 1000) -> DataFrame:
        """One page. The other columns complete the order, so that pages do not overlap."""
        rows = self.build(source)
        return page(rows, [*self._order(), *[F.col(c) for c in rows.columns]], size, number)

    def write(self, source, path: str) -> None:
        self.frame(source).write.mode("overwrite").parquet(path)
