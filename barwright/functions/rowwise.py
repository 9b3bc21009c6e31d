"""Expressions over one row, and aggregates that skip NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigurationError
from ..model import Series

C = Column | str


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def typical_price(high: C, low: C, close: C) -> Column:
    return (_c(high) + _c(low) + _c(close)) / 3


def median_price(high: C, low: C) -> Column:
    return (_c(high) + _c(low)) / 2


def weighted_close(high: C, low: C, close: C) -> Column:
    return (_c(high) + _c(low) + _c(close) * 2) / 4


def money_flow(high: C, low: C, close: C, volume: C) -> Column:
    return typical_price(high, low, close) * _c(volume)


def pivot_points(high: C, low: C, close: C) -> dict[str, Column]:
    """pp, r1..r3, s1..s3; null where a price is absent or high < low."""
    h, lo, c = _c(high), _c(low), _c(close)
    fine = h >= lo
    pp, spread = typical_price(h, lo, c), h - lo
    made = {"pp": pp, "r1": pp * 2 - lo, "r2": pp + spread, "r3": h + (pp - lo) * 2, "s1": pp * 2 - h, "s2": pp - spread, "s3": lo - (h - pp) * 2}
    return {k: F.when(fine, v) for k, v in made.items()}


#: The retracement levels.
FIBONACCI = (0.0, 0.236, 0.382, 0.5, 0.618, 1.0)


def fibonacci_retracement(high: C, low: C) -> dict[str, Column]:
    """fib_0 .. fib_1000 in thousandths of the range below the high; null unless high > low."""
    h, lo = _c(high), _c(low)
    return {f"fib_{round(x * 1000)}": F.when(h > lo, h - (h - lo) * x) for x in FIBONACCI}


def is_missing(x: C) -> Column:
    return _c(x).isNull() | F.isnan(_c(x))


def replace_missing(x: C, value: float = 0.0) -> Column:
    return F.when(is_missing(x), F.lit(float(value))).otherwise(_c(x))


def present(x: C) -> Column:
    """The value, null for NaN."""
    return F.when(~F.isnan(_c(x)), _c(x))


def nan_min(x: C) -> Column:
    return F.min(present(x))


def nan_max(x: C) -> Column:
    return F.max(present(x))


def nan_bounds(df: DataFrame, high: str = "high", low: str = "low", keys: tuple[str, ...] = ()) -> DataFrame:
    """Least low and greatest high, in one aggregation."""
    return df.groupBy(*keys).agg(nan_min(low).alias("min_low"), nan_max(high).alias("max_high"))


def normalize(x: C, low: C, high: C) -> Column:
    """(x - low) / (high - low), 0 where there is no range."""
    return F.when(_c(high) == _c(low), F.lit(0.0)).otherwise((_c(x) - _c(low)) / (_c(high) - _c(low)))


def clip(x: C, low: float, high: float) -> Column:
    """Clamped; null and NaN stay as they are."""
    return F.when(is_missing(x), _c(x)).otherwise(F.least(F.greatest(_c(x), F.lit(float(low))), F.lit(float(high))))


def fill_forward(x: C, s: Series) -> Column:
    return F.last(_c(x), ignorenulls=True).over(s.running)


def fill_backward(x: C, s: Series) -> Column:
    return F.first(_c(x), ignorenulls=True).over(s.w.rowsBetween(0, Window.unboundedFollowing))


def difference(x: C, s: Series, periods: int = 1) -> Column:
    return _c(x) - s.prev(_c(x), periods)


def missing_positions(df: DataFrame, x: str, s: Series) -> DataFrame:
    """keys and 0-based ``position`` of rows where x is absent."""
    return df.select(*s.keys, (F.row_number().over(s.w) - 1).alias("position"), is_missing(x).alias("gone")).where("gone").drop("gone")


def broken_candle(open_: C = "open", high: C = "high", low: C = "low", close: C = "close") -> Column:
    """True where the four prices contradict each other."""
    o, h, lo, c = map(_c, (open_, high, low, close))
    return (h < lo) | (h < o) | (h < c) | (lo > o) | (lo > c)


def rgba(color: str, alpha: int = 255) -> tuple[int, int, int, int]:
    """#rgb, #rrggbb or #rrggbbaa as four numbers."""
    digits = color.lstrip("#")
    if len(digits) == 3:
        digits = "".join(d * 2 for d in digits)
    if len(digits) not in (6, 8):
        raise ConfigurationError(f"not a colour: {color!r}")
    try:
        parts = tuple(bytes.fromhex(digits))
    except ValueError:
        raise ConfigurationError(f"not a colour: {color!r}") from None
    return (*parts[:3], parts[3] if len(parts) == 4 else alpha)
