"""Bars from ticks and from finer bars.

Bars by time, count and volume are aggregations whose bar number comes from running totals that are
split by chunk (see ``totals``), so one hot series is no bottleneck. Range, Kagi and line-break bars
depend on the path and are emitted by one ordered pass per series.
"""

from __future__ import annotations

import math
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigurationError, period, positive
from ..model import Series, need
from .scan import emit
from .totals import running_totals

Arrays = dict[str, np.ndarray]
#: The timeframes.
TIMEFRAMES = {"1m": "1 minute", "5m": "5 minutes", "15m": "15 minutes", "30m": "30 minutes", "1h": "1 hour", "4h": "4 hours", "12h": "12 hours", "1d": "1 day"}
OHLC = (("open", "double"), ("high", "double"), ("low", "double"), ("close", "double"), ("volume", "double"))


def _summary(s: Series, price: str, volume: str | Column) -> list[Column]:
    order = F.struct(*s.order)
    return [
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.sum(volume).alias("volume"),
    ]


def time_bars(df: DataFrame, s: Series, timeframe: str, price: str = "price", volume: str | None = "volume") -> DataFrame:
    """Ticks to bars aligned to the epoch, closed left; intervals without ticks have none. keys, ts, open, high, low, close, volume."""
    return _bucketed(df, s, timeframe).groupBy(*s.keys, "_bar").agg(*_summary(s, price, volume or F.lit(0))).withColumnRenamed("_bar", "ts")


def ohlc_resample(df: DataFrame, s: Series, timeframe: str, volume: str | None = "volume") -> DataFrame:
    """Finer candles (open, high, low, close) to coarser ones; the volume is 0 where there is none."""
    need(df, "open", "high", "low", "close")
    order = F.struct(*s.order)
    made = [F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", order).alias("close"), F.sum(volume or F.lit(0)).alias("volume")]
    return _bucketed(df, s, timeframe).groupBy(*s.keys, "_bar").agg(*made).withColumnRenamed("_bar", "ts")


def _bucketed(df: DataFrame, s: Series, timeframe: str) -> DataFrame:
    if timeframe not in TIMEFRAMES:
        raise ConfigurationError(f"timeframe must be one of {', '.join(TIMEFRAMES)}, got {timeframe!r}")
    need(df, *s.keys, *s.order)
    return df.withColumn("_bar", F.window(F.col(s.order[0]).cast("timestamp"), TIMEFRAMES[timeframe])["start"])


def tick_bars(df: DataFrame, s: Series, size: int, price: str = "price", volume: str = "volume") -> DataFrame:
    """A bar for every ``size`` ticks, the last one as far as it came. keys, bar, ts of the first tick, prices, volume."""
    period(size=size)
    rows = running_totals(df, s, {"_n": F.lit(1)}).withColumn("bar", F.floor((F.col("_n") - 1) / size).cast("long"))
    return rows.groupBy(*s.keys, "bar").agg(F.min(s.order[0]).alias("ts"), *_summary(s, price, volume))


def volume_bars(df: DataFrame, s: Series, size: float, price: str = "price", volume: str = "volume") -> DataFrame:
    """The bar is the whole part of the volume so far, this tick included, over ``size``: the tick that crosses a boundary opens the next bar."""
    positive(size=size)
    rows = running_totals(df, s, {"_v": F.col(volume)}).withColumn("bar", F.floor(F.col("_v") / size).cast("long"))
    return rows.groupBy(*s.keys, "bar").agg(F.min(s.order[0]).alias("ts"), *_summary(s, price, volume))


def _stamp(micros: int) -> Any:
    return np.datetime64(int(micros), "us").item()


class RangeBars:
    """A bar grows until high - low reaches ``size``; that tick closes it. The last bar counts if it has volume."""

    fields = (("ts", "timestamp"), *OHLC)

    def __init__(self, size: float, ts: str, price: str, volume: str):
        self.size, self.ts, self.price, self.volume = size, ts, price, volume

    def start(self) -> list | None:
        return None

    def run(self, bar: list | None, x: Arrays) -> tuple[list[tuple], list | None]:
        out = []
        for t, p, v in zip(x[self.ts].tolist(), x[self.price].tolist(), x[self.volume].tolist()):
            if math.isnan(p):
                continue
            v = 0.0 if math.isnan(v) else v
            if bar is None:
                bar = [t, p, p, p, p, v]
            else:
                bar[2], bar[3], bar[4], bar[5] = max(bar[2], p), min(bar[3], p), p, bar[5] + v
            if bar[2] - bar[3] >= self.size:
                out.append((_stamp(bar[0]), *bar[1:]))
                bar = None
        return out, bar

    def finish(self, bar: list | None) -> list[tuple]:
        return [(_stamp(bar[0]), *bar[1:])] if bar and bar[5] > 0 else []


class CountBars:
    """Bars of a number of ticks, or of a volume (the tick that crosses a boundary opens the next bar), in one pass: for streams. Batches sum up by chunks."""

    fields = (("bar", "long"), ("ts", "timestamp"), *OHLC)

    def __init__(self, size: float, by_volume: bool, ts: str, price: str, volume: str):
        self.size, self.by_volume, self.ts, self.price, self.volume = size, by_volume, ts, price, volume

    def start(self) -> dict:
        return {"sum": 0.0, "bar": None}

    @staticmethod
    def _row(bar: list) -> tuple:
        return (bar[0], _stamp(bar[1]), *bar[2:])

    def run(self, state: dict, x: Arrays) -> tuple[list[tuple], dict]:
        out, held, total = [], state["bar"], state["sum"]
        for t, p, v in zip(x[self.ts].tolist(), x[self.price].tolist(), x[self.volume].tolist()):
            v = 0.0 if math.isnan(v) else v
            # a tick is counted after it is placed, a volume before
            number = int((total + v) // self.size) if self.by_volume else int(total // self.size)
            total += v if self.by_volume else 1
            if held is not None and held[0] != number:
                out.append(self._row(held))
                held = None
            if held is None:
                held = [number, t, p, p, p, p, v]
            else:
                # min and max pass over what is absent
                held[3], held[4], held[5], held[6] = np.fmax(held[3], p).item(), np.fmin(held[4], p).item(), p, held[6] + v
        return out, {"sum": total, "bar": held}

    def finish(self, state: dict) -> list[tuple]:
        return [self._row(state["bar"])] if state["bar"] else []


class KagiLines:
    """Lines that turn when the price comes back by ``amount``, or by ``share`` of the line's end. The turning tick widens the line it ends; its volume is the new line's."""

    fields = (("ts", "timestamp"), *OHLC)

    def __init__(self, amount: float | None, share: float | None, ts: str, price: str, volume: str):
        self.amount, self.share, self.ts, self.price, self.volume = amount, share, ts, price, volume

    def start(self) -> dict | None:
        return None

    @staticmethod
    def _row(line: dict) -> tuple:
        return (_stamp(line["t"]), line["from"], line["high"], line["low"], line["to"], line["v"])

    def run(self, line: dict | None, x: Arrays) -> tuple[list[tuple], dict | None]:
        out = []
        for t, p, v in zip(x[self.ts].tolist(), x[self.price].tolist(), x[self.volume].tolist()):
            if math.isnan(p):
                continue
            v = 0.0 if math.isnan(v) else v
            if line is None:
                line = {"t": t, "from": p, "to": p, "way": 0, "v": v, "high": p, "low": p}
                continue
            line["high"], line["low"] = max(line["high"], p), min(line["low"], p)
            ahead = (p - line["to"]) * (line["way"] or 1)
            if line["way"] == 0:
                line["way"], line["to"] = (p > line["from"]) - (p < line["from"]), p
            elif ahead > 0:
                line["to"] = p
            elif -ahead >= (self.amount if self.share is None else abs(line["to"]) * self.share):
                out.append(self._row(line))
                end, way = line["to"], -line["way"]
                line = {"t": t, "from": end, "to": p, "way": way, "v": v, "high": max(end, p), "low": min(end, p)}
                continue
            line["v"] += v
        return out, line

    def finish(self, line: dict | None) -> list[tuple]:
        return [self._row(line)] if line and line["way"] else []


class LineBreak:
    """A line continues when the price passes its extreme, and turns when it passes that of the last ``lines`` lines.

    The first line runs from the first price to the first that differs; a continuation opens at the last close, a
    turn at the last open; ticks that break nothing add volume to the last line.
    ``compat``: one bar over the whole input.
    """

    fields = (("ts", "timestamp"), *OHLC)

    def __init__(self, lines: int, compat: bool, ts: str, price: str, volume: str):
        self.lines, self.compat, self.ts, self.price, self.volume = lines, compat, ts, price, volume

    def start(self) -> dict:
        return {"first": None, "held": [], "way": 0}

    def run(self, state: dict, x: Arrays) -> tuple[list[tuple], dict]:
        out, held = [], state["held"]
        for t, p, v in zip(x[self.ts].tolist(), x[self.price].tolist(), x[self.volume].tolist()):
            if math.isnan(p):
                continue
            v = 0.0 if math.isnan(v) else v
            if self.compat:
                if not held:
                    held.append([t, p, p, p, p, v])
                else:
                    bar = held[0]
                    bar[2], bar[3], bar[4], bar[5] = max(bar[2], p), min(bar[3], p), p, bar[5] + v
                continue
            if not held:
                if state["first"] is None:
                    state["first"] = [t, p, v]
                elif p == state["first"][1]:
                    state["first"][2] += v
                else:
                    t0, p0, v0 = state["first"]
                    held.append([t0, p0, max(p0, p), min(p0, p), p, v0 + v])
                    state["way"] = 1 if p > p0 else -1
                continue
            last, top, bottom = held[-1], max(b[2] for b in held), min(b[3] for b in held)
            if p > last[2] if state["way"] > 0 else p < last[3]:
                base = last[4]
            elif p <= bottom and p < last[3] if state["way"] > 0 else p >= top and p > last[2]:
                base, state["way"] = last[1], -state["way"]
            else:
                last[5] += v
                continue
            held.append([t, base, max(base, p), min(base, p), p, v])
            if len(held) > self.lines:
                gone = held.pop(0)
                out.append((_stamp(gone[0]), *gone[1:]))
        return out, state

    def finish(self, state: dict) -> list[tuple]:
        return [(_stamp(b[0]), *b[1:]) for b in state["held"]]


def range_bars(df: DataFrame, s: Series, size: float, price: str = "price", volume: str = "volume") -> DataFrame:
    positive(size=size)
    return emit(df, s, [s.order[0], price, volume], RangeBars(size, s.order[0], price, volume))


def kagi(df: DataFrame, s: Series, amount: float | None = None, share: float | None = None, price: str = "price", volume: str = "volume") -> DataFrame:
    if (amount is None) == (share is None):
        raise ConfigurationError("exactly one of amount and share is needed")
    return emit(df, s, [s.order[0], price, volume], KagiLines(amount, share, s.order[0], price, volume))


def three_line_break(df: DataFrame, s: Series, lines: int = 3, price: str = "price", volume: str = "volume", compat: bool = False) -> DataFrame:
    period(lines=lines)
    return emit(df, s, [s.order[0], price, volume], LineBreak(lines, compat, s.order[0], price, volume))
