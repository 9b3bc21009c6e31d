"""Indicators that look at a fixed number of rows: window expressions only, one exchange for all of them on the same series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import period, positive
from ..functions.rowwise import typical_price
from ..model import EPSILON, Series
from .kernels import Aroon
from .scan import scan


def rolling_max(x: str, s: Series, window: int) -> Column:
    period(window=window)
    return s.full(window, F.max(x), x)


def rolling_min(x: str, s: Series, window: int) -> Column:
    period(window=window)
    return s.full(window, F.min(x), x)


def rolling_mean(x: str, s: Series, window: int, min_periods: int | None = None) -> Column:
    """Null before the window is complete, and where fewer than ``min_periods`` (the window) values are present."""
    period(window=window)
    enough = (F.count(F.lit(1)).over(s.last(window)) >= window) & (F.count(x).over(s.last(window)) >= (min_periods or window))
    return F.when(enough, F.avg(x).over(s.last(window)))


def rolling_std(x: str, s: Series, window: int, ddof: int = 1) -> Column:
    period(window=window)
    return s.full(window, F.stddev_samp(x) if ddof else F.stddev_pop(x), x)


def rolling_sum(x: str, s: Series, window: int, min_periods: int | None = None) -> Column:
    """Null until ``min_periods`` (the window) values are present, so a partial frame counts when it is smaller."""
    period(window=window)
    return F.when(F.count(x).over(s.last(window)) >= (min_periods or window), F.sum(x).over(s.last(window)))


def percentage_change(x: str, s: Series, periods: int = 1) -> Column:
    period(periods=periods)
    return (F.try_divide(F.col(x), s.prev(x, periods)) - 1) * 100


def true_range(s: Series, high: str = "high", low: str = "low", close: str = "close", first: bool = True) -> Column:
    """Greatest of high - low and the distances to the last close; at the first row high - low, or null."""
    before = s.prev(close)
    made = F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - before), F.abs(F.col(low) - before))
    return made if first else F.when(before.isNotNull(), made)


def gain_loss(x: str, s: Series) -> tuple[Column, Column]:
    step = F.col(x) - s.prev(x)
    return F.greatest(step, F.lit(0.0) + step * 0), F.greatest(-step, step * 0)


def directional_movement(s: Series, high: str = "high", low: str = "low") -> tuple[Column, Column]:
    up, down = F.col(high) - s.prev(high), s.prev(low) - F.col(low)
    return F.when((up > down) & (up > 0), up).when(up.isNotNull(), 0.0), F.when((down > up) & (down > 0), down).when(down.isNotNull(), 0.0)


def signed_money_flow(s: Series, high: str = "high", low: str = "low", close: str = "close", volume: str = "volume") -> tuple[Column, Column]:
    """Money flow of rows whose typical price rose, and of those where it fell; the other is 0, both null at the first row."""
    now = typical_price(high, low, close)
    step, flow = now - s.prev(now), now * F.col(volume)
    return F.when(step > 0, flow).when(step.isNotNull(), 0.0), F.when(step < 0, flow).when(step.isNotNull(), 0.0)


def sma(df: DataFrame, s: Series, n: int = 20, x: str = "close", out: str = "sma") -> DataFrame:
    period(n=n)
    return df.withColumn(out, s.mean(n, x))


def _wma(x: str, s: Series, n: int) -> Column:
    """The newest of n rows weighs n, the oldest 1. Long windows weigh a list of their values instead of n lags."""
    if n <= 64:
        total = sum(((n - k) * s.prev(x, k) for k in range(1, n)), n * F.col(x))
        return total / (n * (n + 1) / 2)
    weighed = F.transform(F.collect_list(F.col(x).cast("double")).over(s.last(n)), lambda v, i: v * (i + 1))
    return F.when(F.count(x).over(s.last(n)) >= n, F.aggregate(weighed, F.lit(0.0), lambda a, v: a + v) / (n * (n + 1) / 2))


def wma(df: DataFrame, s: Series, n: int = 20, x: str = "close", out: str = "wma") -> DataFrame:
    period(n=n)
    return df.withColumn(out, _wma(x, s, n))


def vwma(df: DataFrame, s: Series, n: int = 20, x: str = "close", volume: str = "volume", out: str = "vwma") -> DataFrame:
    period(n=n)
    pv = F.col(x) * F.col(volume)
    return df.withColumn(out, F.try_divide(s.full(n, F.sum(pv), pv), F.sum(volume).over(s.last(n))))


def hma(df: DataFrame, s: Series, n: int = 20, x: str = "close", out: str = "hma") -> DataFrame:
    """Weighted average over round(sqrt n) rows of twice the half-length weighted average less the whole one."""
    period(n=n)
    rows = wma(wma(df, s, max(1, n // 2), x, "_half"), s, n, x, "_whole").withColumn("_lead", F.col("_half") * 2 - F.col("_whole"))
    return wma(rows, s, max(1, round(n**0.5)), "_lead", out).drop("_half", "_whole", "_lead")


def aroon(df: DataFrame, s: Series, n: int = 25, high: str = "high", low: str = "low") -> DataFrame:
    """aroon_up and aroon_down over n rows (not n + 1); of equal extremes the latest counts. One pass: a window would look at n rows for each."""
    period(n=n)
    return scan(df, s, [high, low], [Aroon(n, high, low)])


def ichimoku(df: DataFrame, s: Series, conversion: int = 9, base: int = 26, span: int = 52, displacement: int = 26, high: str = "high", low: str = "low", close: str = "close") -> DataFrame:
    """tenkan, kijun, senkou_a, senkou_b (shifted forward), chikou (shifted back)."""
    period(conversion=conversion, base=base, span=span)
    middle = lambda n: (s.full(n, F.max(high), high) + s.full(n, F.min(low), low)) / 2
    rows = df.withColumns({"tenkan": middle(conversion), "kijun": middle(base), "_b": middle(span)})
    return rows.withColumns(
        {
            "senkou_a": s.prev((F.col("tenkan") + F.col("kijun")) / 2, displacement),
            "senkou_b": s.prev("_b", displacement),
            "chikou": F.lead(close, displacement).over(s.w),
        }
    ).drop("_b")


def stochastic(df: DataFrame, s: Series, n: int = 14, d: int = 3, high: str = "high", low: str = "low", close: str = "close", k_out: str = "stoch_k", d_out: str = "stoch_d") -> DataFrame:
    period(n=n, d=d)
    top, bottom = s.full(n, F.max(high), high), s.full(n, F.min(low), low)
    return df.withColumn(k_out, (F.col(close) - bottom) * 100 / (top - bottom + EPSILON)).withColumn(d_out, s.mean(d, k_out))


def williams_r(df: DataFrame, s: Series, n: int = 14, high: str = "high", low: str = "low", close: str = "close", out: str = "williams_r") -> DataFrame:
    period(n=n)
    top, bottom = s.full(n, F.max(high), high), s.full(n, F.min(low), low)
    return df.withColumn(out, (top - F.col(close)) * -100 / (top - bottom + EPSILON))


def cci(df: DataFrame, s: Series, n: int = 20, constant: float = 0.015, high: str = "high", low: str = "low", close: str = "close", out: str = "cci") -> DataFrame:
    """Each row's deviation is from its own average, not the current one."""
    period(n=n)
    positive(constant=constant)
    rows = df.withColumn("_tp", typical_price(high, low, close)).withColumn("_off", F.col("_tp") - s.mean(n, "_tp")).withColumn("_far", F.abs("_off"))
    return rows.withColumn(out, F.col("_off") / (s.mean(n, "_far") * constant + EPSILON)).drop("_tp", "_off", "_far")


def roc(df: DataFrame, s: Series, n: int = 12, x: str = "close", out: str = "roc") -> DataFrame:
    period(n=n)
    return df.withColumn(out, F.try_divide((F.col(x) - s.prev(x, n)) * 100, s.prev(x, n)))


def mfi(df: DataFrame, s: Series, n: int = 14, high: str = "high", low: str = "low", close: str = "close", volume: str = "volume", out: str = "mfi") -> DataFrame:
    period(n=n)
    up, down = signed_money_flow(s, high, low, close, volume)
    rows = df.withColumns({"_up": up, "_down": down})
    rows = rows.withColumns({"_ups": s.full(n, F.sum("_up"), "_up"), "_downs": s.full(n, F.sum("_down"), "_down")})
    made = F.when(F.col("_ups") < EPSILON, 0.0).when(F.col("_downs") < EPSILON, 100.0).otherwise(100 - F.lit(100) / (F.col("_ups") / (F.col("_downs") + EPSILON) + 1))
    return rows.withColumn(out, F.when(F.col("_ups").isNotNull(), made)).drop("_up", "_down", "_ups", "_downs")


def bollinger(df: DataFrame, s: Series, n: int = 20, k: float = 2.0, x: str = "close") -> DataFrame:
    """bb_upper, bb_middle, bb_lower with the sample deviation."""
    period(n=n)
    middle, off = s.mean(n, x), s.full(n, F.stddev_samp(x), x) * k
    return df.withColumns({"bb_upper": middle + off, "bb_middle": middle, "bb_lower": middle - off})


def donchian(df: DataFrame, s: Series, n: int = 20, high: str = "high", low: str = "low") -> DataFrame:
    period(n=n)
    top, bottom = s.full(n, F.max(high), high), s.full(n, F.min(low), low)
    return df.withColumns({"dc_upper": top, "dc_middle": (top + bottom) / 2, "dc_lower": bottom})


def cmf(df: DataFrame, s: Series, n: int = 20, high: str = "high", low: str = "low", close: str = "close", volume: str = "volume", out: str = "cmf") -> DataFrame:
    period(n=n)
    h, lo, c, v = F.col(high), F.col(low), F.col(close), F.col(volume)
    flow = (c * 2 - h - lo) / (h - lo + EPSILON) * v
    return df.withColumn(out, s.full(n, F.sum(flow), flow) / (F.sum(volume).over(s.last(n)) + EPSILON))


def swing_points(df: DataFrame, s: Series, n: int = 10, high: str = "high", low: str = "low") -> DataFrame:
    """swing_high: at least all n highs before and above all n after; swing_low mirrors it. False without n rows on either side."""
    period(n=n)
    before, after = s.w.rowsBetween(-n, -1), s.w.rowsBetween(1, n)
    whole = (F.count(F.lit(1)).over(before) == n) & (F.count(F.lit(1)).over(after) == n)
    peak = (F.col(high) >= F.max(high).over(before)) & (F.col(high) > F.max(high).over(after))
    trough = (F.col(low) <= F.min(low).over(before)) & (F.col(low) < F.min(low).over(after))
    return df.withColumns({"swing_high": F.coalesce(whole & peak, F.lit(False)), "swing_low": F.coalesce(whole & trough, F.lit(False))})


def moving_linear_fit(df: DataFrame, s: Series, n: int, x: str = "close") -> DataFrame:
    """fit_slope and fit_intercept of the last n values against 0 .. n - 1."""
    period(n=n)
    at = F.col("_at").cast("double")
    slope = s.full(n, F.regr_slope(F.col(x), at), x)
    rows = df.withColumn("_at", F.row_number().over(s.w)).withColumn("fit_slope", slope)
    return rows.withColumn("fit_intercept", s.mean(n, x) - F.col("fit_slope") * ((n - 1) / 2)).drop("_at")


