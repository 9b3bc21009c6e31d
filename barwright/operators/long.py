"""Series too long for one task, in blocks of rows.

Rows are numbered by running totals that are themselves split (see ``totals``), so no step brings a whole
series together. Windows of a fixed number of rows get the rows before (and after) their block as a halo.
Exponential smoothing is an affine recurrence: a block's effect is a factor and a sum, so one pass sums up
blocks, a pass over those sums gives each block's starting value, and a second pass smooths the rows. RSI, ATR,
Keltner, MACD and TSI are such smoothers of what one row and the row before it give.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigurationError, not_negative, period
from ..model import EPSILON, Series
from .kernels import Arrays, Smoother
from .scan import emit, scan
from .totals import previous, running_totals

ROWS = 200_000
PARTS = ("first", "factor", "total", "count")


def _numbered(df: DataFrame, s: Series, rows: int) -> DataFrame:
    at = F.col("_n") - 1
    made = running_totals(df, s, {"_n": F.lit(1)})
    return made.withColumns({"_block": F.floor(at / rows).cast("long"), "_at": (at % rows).cast("long")}).drop("_n")


def blocked(df: DataFrame, s: Series, back: int, add: Callable[[DataFrame, Series], DataFrame], ahead: int = 0, rows: int = ROWS) -> DataFrame:
    """``add(df, series)`` run by blocks of ``rows`` rows, for columns that look at most ``back`` rows back and ``ahead`` ahead.

    The result is that of ``add`` on whole series, in as many tasks as there are blocks.
    """
    not_negative(back=back, ahead=ahead)
    if back + ahead >= rows:
        raise ConfigurationError(f"blocks of {rows} rows are too short for windows of {back + ahead}")
    home = _numbered(df, s, rows).withColumnRenamed("_block", "_home")
    places = F.array(F.col("_home"), F.when(F.col("_at") >= rows - back, F.col("_home") + 1), F.when(F.col("_at") < ahead, F.col("_home") - 1))
    spread = home.withColumn("_block", F.explode(F.array_compact(places))).drop("_at")
    return add(spread, Series((*s.keys, "_block"), s.order, None)).where(F.col("_block") == F.col("_home")).drop("_block", "_home")


@dataclass(frozen=True)
class Smooth:
    """out = alpha x + (1 - alpha) out from x's first value on, absent until ``least`` values were seen."""

    x: str
    alpha: float
    out: str
    least: int = 1


class _Sums:
    """Of each smoother: first (a series' first value, if it is in the block), factor and total (what the block does to the value before it), count of values."""

    def __init__(self, smooths: tuple[Smooth, ...]):
        self.smooths = smooths
        self.fields = (("_block", "long"), *[(f"_{c}{i}", "double") for i in range(len(smooths)) for c in PARTS])

    def start(self) -> tuple:
        return (0, [(math.nan, 0.0, 0)] * len(self.smooths))

    def run(self, state: tuple, x: Arrays) -> tuple[list[tuple], tuple]:
        after = []
        for m, (first, total, n) in zip(self.smooths, state[1]):
            values = x[m.x]
            there = values[~np.isnan(values)]
            if len(there):
                first = first if n else float(there[0])
                _, (total, _) = Smoother(m.alpha).run((total, 1), there)
            after.append((first, total, n + len(there)))
        return [], (int(x["_block"][0]), after)

    def finish(self, state: tuple) -> list[tuple]:
        return [(state[0], *[v for m, (first, total, n) in zip(self.smooths, state[1]) for v in (first, (1 - m.alpha) ** n, total, float(n))])]


class _Carry:
    """The value before each block, and how many values came before, for each smoother."""

    def __init__(self, count: int):
        self.count = count
        self.outputs = tuple(f"_{c}{i}" for i in range(count) for c in ("start", "seen"))

    def start(self) -> list[tuple]:
        return [(math.nan, 0.0)] * self.count

    def run(self, state: list[tuple], x: Arrays) -> tuple[Arrays, list[tuple]]:
        out, after = {}, []
        for i, (value, seen) in enumerate(state):
            starts, counts = [], []
            for first, factor, total, n in zip(*(x[f"_{c}{i}"].tolist() for c in PARTS)):
                value = first if math.isnan(value) else value  # before its first value a series stands at that value
                starts.append(value)
                counts.append(seen)
                if n:
                    value, seen = factor * value + total, seen + n
            out |= {f"_start{i}": np.array(starts), f"_seen{i}": np.array(counts)}
            after.append((value, seen))
        return out, after


class _Continued:
    """The smoothers of a block, each from the value that came before."""

    def __init__(self, smooths: tuple[Smooth, ...]):
        self.smooths, self.outputs = smooths, tuple(m.out for m in smooths)

    def start(self) -> None:
        return None

    def run(self, state: list | None, x: Arrays) -> tuple[Arrays, list]:
        made, after = {}, []
        for i, m in enumerate(self.smooths):
            smoother = Smoother(m.alpha, m.least)
            if state is None:
                seen = int(x[f"_seen{i}"][0])
                held = (float(x[f"_start{i}"][0]), seen) if seen else smoother.start()
            else:
                held = state[i]
            made[m.out], held = smoother.run(held, x[m.x])
            after.append(held)
        return made, after


def numbered(df: DataFrame, s: Series, rows: int = ROWS) -> DataFrame:
    """Adds ``_block``. What is smoothed again need not be numbered again."""
    return _numbered(df, s, rows).drop("_at")


def smooth_all(df: DataFrame, s: Series, *smooths: Smooth) -> DataFrame:
    """All smoothers of numbered rows in one pass over sums and one over rows, equal to the one-pass smoother up to rounding."""
    by = Series((*s.keys, "_block"), s.order, None)
    inputs = list(dict.fromkeys(m.x for m in smooths))
    # the block is a key of the pass and a field of its rows
    sums = emit(df.withColumn("_group", F.col("_block")), Series((*s.keys, "_group"), s.order, None), ["_block", *inputs], _Sums(smooths)).drop("_group")
    starts = scan(sums, Series(s.keys, ("_block",), None), [f"_{c}{i}" for i in range(len(smooths)) for c in PARTS], [_Carry(len(smooths))])
    held = [f"_{c}{i}" for i in range(len(smooths)) for c in ("start", "seen")]
    starts = starts.select(F.struct(*by.keys).alias("_id"), *held)
    joined = df.withColumn("_id", F.struct(*by.keys)).join(starts, "_id").drop("_id")
    return scan(joined, by, [*inputs, *held], [_Continued(smooths)]).drop(*held)


def smooth(df: DataFrame, s: Series, alpha: float, least: int = 1, x: str = "close", out: str = "ema", rows: int = ROWS) -> DataFrame:
    period(least=least)
    return smooth_all(numbered(df, s, rows), s, Smooth(x, alpha, out, least)).select(*df.columns, out)


def ema(df: DataFrame, s: Series, n: int = 12, x: str = "close", out: str = "ema", rows: int = ROWS) -> DataFrame:
    period(n=n)
    return smooth(df, s, 2 / (n + 1), n, x, out, rows)


def _ema(x: str, n: int, out: str, least: int | None = None) -> Smooth:
    return Smooth(x, 2 / (n + 1), out, n if least is None else least)


def rsi(df: DataFrame, s: Series, n: int = 14, x: str = "close", out: str = "rsi", rows: int = ROWS) -> DataFrame:
    period(n=n)
    step = F.col(x) - F.coalesce(F.col("_was"), F.col(x))
    moved = previous(df, s, x, "_was").withColumns({"_gain": F.greatest(step, step * 0), "_loss": F.greatest(-step, step * 0)})
    made = smooth_all(numbered(moved, s, rows), s, Smooth("_gain", 1 / n, "_gains"), Smooth("_loss", 1 / n, "_losses"))
    return made.withColumn(out, F.lit(100.0) - F.lit(100.0) / (F.col("_gains") / (F.col("_losses") + EPSILON) + 1)).select(*df.columns, out)


def _ranged(df: DataFrame, s: Series, high: str, low: str, close: str) -> DataFrame:
    before = F.col("_was")
    return previous(df, s, close, "_was").withColumn("_range", F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - before), F.abs(F.col(low) - before)))


def atr(df: DataFrame, s: Series, n: int = 14, high: str = "high", low: str = "low", close: str = "close", out: str = "atr", rows: int = ROWS) -> DataFrame:
    period(n=n)
    return smooth_all(numbered(_ranged(df, s, high, low, close), s, rows), s, Smooth("_range", 1 / n, out)).select(*df.columns, out)


def keltner(df: DataFrame, s: Series, n: int = 20, multiplier: float = 2.0, high: str = "high", low: str = "low", close: str = "close", rows: int = ROWS) -> DataFrame:
    period(n=n)
    not_negative(multiplier=multiplier)
    made = smooth_all(numbered(_ranged(df, s, high, low, close), s, rows), s, _ema(close, n, "kc_middle", 1), Smooth("_range", 1 / n, "_wide"))
    off = F.col("_wide") * multiplier
    return made.withColumns({"kc_upper": F.col("kc_middle") + off, "kc_lower": F.col("kc_middle") - off}).select(*df.columns, "kc_upper", "kc_middle", "kc_lower")


def macd(df: DataFrame, s: Series, fast: int = 12, slow: int = 26, signal: int = 9, x: str = "close", rows: int = ROWS) -> DataFrame:
    period(fast=fast, slow=slow, signal=signal)
    made = smooth_all(numbered(df, s, rows), s, _ema(x, fast, "_fast"), _ema(x, slow, "_slow")).withColumn("macd_line", F.col("_fast") - F.col("_slow"))
    made = smooth_all(made, s, _ema("macd_line", signal, "macd_signal"))
    return made.withColumn("macd_histogram", F.col("macd_line") - F.col("macd_signal")).select(*df.columns, "macd_line", "macd_signal", "macd_histogram")


def tsi(df: DataFrame, s: Series, slow: int = 25, fast: int = 13, x: str = "close", out: str = "tsi", rows: int = ROWS) -> DataFrame:
    period(slow=slow, fast=fast)
    moved = previous(df, s, x, "_was").withColumn("_step", F.col(x) - F.col("_was")).withColumn("_size", F.abs("_step"))
    made = smooth_all(numbered(moved, s, rows), s, _ema("_step", slow, "_a"), _ema("_size", slow, "_b"))
    made = smooth_all(made, s, _ema("_a", fast, "_aa"), _ema("_b", fast, "_bb"))
    return made.withColumn(out, F.col("_aa") * 100 / (F.col("_bb") + EPSILON)).select(*df.columns, out)
