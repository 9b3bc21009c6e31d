"""Indicators that depend on their own past, each one pass over the series (see ``scan``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigurationError, not_negative, period
from ..model import Series
from . import kernels as K
from . import rolling
from .scan import scan


def ema(df: DataFrame, s: Series, n: int = 12, x: str = "close", out: str = "ema") -> DataFrame:
    period(n=n)
    return scan(df, s, [x], [K.ema(x, n, out)])


def ewm_mean(df: DataFrame, s: Series, span: int, adjust: bool = True, x: str = "close", out: str = "ewm") -> DataFrame:
    period(span=span)
    return scan(df, s, [x], [K.SeededEwm(x, span, adjust, out)])


def wilder(df: DataFrame, s: Series, n: int, x: str = "close", out: str = "wilder") -> DataFrame:
    period(n=n)
    return scan(df, s, [x], [K.Chain((out,), lambda k, a: {out: k.smooth("w", K.Wilder(n), a[x])})])


def dema(df: DataFrame, s: Series, n: int = 20, x: str = "close", out: str = "dema", compat: bool = False) -> DataFrame:
    """``compat``: all null, as where the inner warm-up poisons the outer average."""
    period(n=n)
    return df.withColumn(out, F.lit(None).cast("double")) if compat else scan(df, s, [x], [K.dema(x, n, out)])


def tema(df: DataFrame, s: Series, n: int = 20, x: str = "close", out: str = "tema", compat: bool = False) -> DataFrame:
    period(n=n)
    return df.withColumn(out, F.lit(None).cast("double")) if compat else scan(df, s, [x], [K.dema(x, n, out, third=True)])


def macd(df: DataFrame, s: Series, fast: int = 12, slow: int = 26, signal: int = 9, x: str = "close") -> DataFrame:
    period(fast=fast, slow=slow, signal=signal)
    return scan(df, s, [x], [K.macd(x, fast, slow, signal)])


def rsi(df: DataFrame, s: Series, n: int = 14, x: str = "close", out: str = "rsi") -> DataFrame:
    period(n=n)
    return scan(df, s, [x], [K.rsi(x, n, out)])


def stochastic_rsi(df: DataFrame, s: Series, n: int = 14, window: int = 14, k: int = 3, d: int = 3, x: str = "close") -> DataFrame:
    """Stochastic of the RSI smoothed over k rows, and that over d rows."""
    period(n=n, window=window, k=k, d=d)
    rows = rolling.stochastic(rsi(df, s, n, x, "_rsi"), s, window, k, "_rsi", "_rsi", "_rsi", "_raw", "stoch_rsi_k")
    return rows.withColumn("stoch_rsi_d", s.mean(d, "stoch_rsi_k")).drop("_rsi", "_raw")


def atr(df: DataFrame, s: Series, n: int = 14, high: str = "high", low: str = "low", close: str = "close", out: str = "atr") -> DataFrame:
    period(n=n)
    return scan(df, s, [high, low, close], [K.atr(n, high, low, close, out)])


def atr_wilder(df: DataFrame, s: Series, n: int = 14, high: str = "high", low: str = "low", close: str = "close", out: str = "atr_wilder") -> DataFrame:
    period(n=n)
    return scan(df, s, [high, low, close], [K.atr_wilder(n, high, low, close, out)])


def tsi(df: DataFrame, s: Series, slow: int = 25, fast: int = 13, x: str = "close", out: str = "tsi") -> DataFrame:
    period(slow=slow, fast=fast)
    return scan(df, s, [x], [K.tsi(x, slow, fast, out)])


def elder_ray(df: DataFrame, s: Series, n: int = 13, high: str = "high", low: str = "low", close: str = "close") -> DataFrame:
    rows = ema(df, s, n, close, "_ema")
    return rows.withColumns({"bull_power": F.col(high) - F.col("_ema"), "bear_power": F.col(low) - F.col("_ema")}).drop("_ema")


def keltner(df: DataFrame, s: Series, n: int = 20, multiplier: float = 2.0, high: str = "high", low: str = "low", close: str = "close") -> DataFrame:
    period(n=n)
    not_negative(multiplier=multiplier)
    return scan(df, s, [high, low, close], [K.keltner(n, multiplier, high, low, close)])


def adx(df: DataFrame, s: Series, n: int = 14, high: str = "high", low: str = "low", close: str = "close") -> DataFrame:
    period(n=n)
    return scan(df, s, [high, low, close], [K.adx(n, high, low, close)])


def parabolic_sar(df: DataFrame, s: Series, start: float = 0.02, step: float = 0.02, most: float = 0.2, high: str = "high", low: str = "low") -> DataFrame:
    if not 0 < start < 1 or not 0 < step < 1 or not start < most < 1:
        raise ConfigurationError(f"needed: 0 < start < most < 1 and 0 < step < 1, got {start}, {step}, {most}")
    return scan(df, s, [high, low], [K.ParabolicSar(start, step, most, high, low)])


def supertrend(df: DataFrame, s: Series, n: int = 10, multiplier: float = 3.0, high: str = "high", low: str = "low", close: str = "close") -> DataFrame:
    period(n=n)
    not_negative(multiplier=multiplier)
    return scan(df, s, [high, low, close], [K.Supertrend(n, multiplier, high, low, close)])


def multiple_averages(df: DataFrame, s: Series, x: str = "close", sma: tuple[int, ...] = (), ema: tuple[int, ...] = (), sma_shift: dict[int, int] | None = None, ema_shift: dict[int, int] | None = None) -> DataFrame:
    """sma_n and ema_n for each window, in one exchange; an ema here has no warm-up. A shift moves a result that many rows on."""
    for n in (*sma, *ema):
        period(n=n)
    if max(len(sma), len(ema)) > 7:
        raise ConfigurationError("at most seven windows of each kind")
    rows = s.arrange(df).withColumns({f"sma_{n}": s.mean(n, x) for n in sma})
    if ema:
        rows = scan(rows, s, [x], [K.several_emas(x, tuple(ema))], arranged=True)
    shifts = {f"sma_{n}": k for n, k in (sma_shift or {}).items()} | {f"ema_{n}": k for n, k in (ema_shift or {}).items()}
    return rows.withColumns({c: s.prev(c, k) for c, k in shifts.items()})


def indicators_batch(df: DataFrame, s: Series, high: str = "high", low: str = "low", close: str = "close", volume: str | None = "volume") -> DataFrame:
    """atr, rsi, stoch_k, stoch_d, bb_*, obv, macd_* with one exchange, one sort and one pass through Python.

    The windows share the arrangement that the recurrences need, so nothing is moved between them.
    """
    rows = rolling.bollinger(rolling.stochastic(s.arrange(df), s, 14, 3, high, low, close), s, 20, 2.0, close)
    if volume is None:
        rows = rows.withColumn("obv", F.lit(None).cast("double"))
    else:
        step = F.coalesce(F.signum(F.col(close) - s.prev(close)) * F.col(volume), F.lit(0.0))
        rows = rows.withColumn("_step", step).withColumn("obv", F.sum("_step").over(s.running)).drop("_step")
    return scan(rows, s, [high, low, close], [K.atr(14, high, low, close), K.rsi(close, 14), K.macd(close, 12, 26, 9)], arranged=True)
