"""The shape of a time series in a table: what tells series apart, and what puts a series in order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .errors import DataValidationError

EPSILON = 1e-10


@dataclass(frozen=True)
class Series:
    """keys: columns that tell series apart. order: columns that put rows in order, the last ones to break ties.

    chunk: an interval by which running totals of long series are split (see ``operators.totals``),
    None for plain windows. It needs a timestamp as first column of ``order``.
    """

    keys: tuple[str, ...] = ()
    order: tuple[str, ...] = ("ts",)
    chunk: str | None = "day"

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def last(self, n: int) -> WindowSpec:
        """The current row and the n - 1 before it."""
        return self.w.rowsBetween(-(n - 1), 0)

    @property
    def running(self) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, 0)

    def full(self, n: int, made: Column, *needed: Column | str) -> Column:
        """``made`` over the last n rows, null until each of ``needed`` has n values there."""
        enough = F.lit(True)
        for c in needed:
            enough = enough & (F.count(c).over(self.last(n)) >= n)
        return F.when(enough, made.over(self.last(n)))

    def mean(self, n: int, c: Column | str) -> Column:
        return self.full(n, F.avg(c), c)

    def prev(self, c: Column | str, n: int = 1) -> Column:
        return F.lag(c, n).over(self.w)

    def arrange(self, df: DataFrame) -> DataFrame:
        """Each series in one partition and in order. Windows on top need no other exchange or sort."""
        need(df, *self.keys, *self.order)
        placed = df.repartition(*[F.col(k) for k in self.keys]) if self.keys else df.repartition(1)
        return placed.sortWithinPartitions(*self.keys, *self.order)


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise DataValidationError(f"Column {', '.join(map(repr, missing))} not found in {df.columns}")


def without_nan(df: DataFrame, *columns: str) -> DataFrame:
    """NaN as null. Inside the engine null alone means that a value is absent."""
    chosen = columns or [n for n, kind in df.dtypes if kind in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in chosen})
