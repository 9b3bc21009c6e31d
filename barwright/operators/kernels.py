"""The recurrences: exponential smoothers and path-dependent indicators.

An absent input (null, NaN) gives an absent output and leaves the state as it was, unless a kernel says otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd

from ..model import EPSILON

Arrays = dict[str, np.ndarray]


class Smoother:
    """y = a x + (1 - a) y from the first value on; absent until ``least`` values were seen."""

    def __init__(self, alpha: float, least: int = 1):
        self.alpha, self.least = alpha, least

    def start(self) -> tuple[float, int]:
        return math.nan, 0

    def run(self, state: tuple[float, int], x: np.ndarray) -> tuple[np.ndarray, tuple[float, int]]:
        last, seen = state
        out = np.full(len(x), np.nan)
        there = ~np.isnan(x)
        values = x[there]
        if not len(values):
            return out, state
        if seen:
            values = np.append(last, values)
        made = pd.Series(values).ewm(alpha=self.alpha, adjust=False).mean().to_numpy()
        made = made[1:] if seen else made
        shown = made.copy()
        shown[: max(0, self.least - 1 - seen)] = np.nan
        out[there] = shown
        return out, (float(made[-1]), seen + len(made))


class Wilder:
    """Seeded with the mean of what is present in the first p rows, then y += (x - y) / p. An absent input repeats y."""

    def __init__(self, p: int):
        self.p = p

    def start(self) -> tuple:
        return (math.nan, 0, 0.0, 0)

    def run(self, state: tuple, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        y, row, total, there = state
        out, p = np.full(len(x), np.nan), self.p
        i, values = 0, x.tolist()
        while i < len(values) and row < p:
            if not math.isnan(values[i]):
                total, there = total + values[i], there + 1
            row += 1
            if row == p:
                y = total / there if there else math.nan
                out[i] = y
            i += 1
        if i < len(values):
            rest = x[i:]
            if math.isnan(y) or np.isnan(rest).any():
                for j, v in enumerate(rest.tolist(), i):
                    if not math.isnan(v):
                        y = v if math.isnan(y) else y + (v - y) / p
                    out[j] = y
            else:
                made = pd.Series(np.append(y, rest)).ewm(alpha=1 / p, adjust=False).mean().to_numpy()[1:]
                out[i:], y = made, float(made[-1])
        return out, (y, row, total, there)


class SeededEwm:
    """The exported smoother: seeded with the mean of the first ``span`` values at row span - 1; alpha 1/span, or 2/(span + 1) if ``adjust``."""

    def __init__(self, x: str, span: int, adjust: bool, out: str):
        self.x, self.span, self.alpha, self.outputs = x, span, 2 / (span + 1) if adjust else 1 / span, (out,)

    def start(self) -> tuple:
        return ((), None)

    def run(self, state: tuple, x: Arrays) -> tuple[Arrays, tuple]:
        head, inner = state
        values = x[self.x]
        out = np.full(len(values), np.nan)
        i = 0
        if inner is None:
            i = min(self.span - len(head), len(values))
            head = (*head, *values[:i].tolist())
            if len(head) == self.span:
                y = float(np.mean(head))
                out[i - 1] = y
                inner, head = (y, 1), ()
        if inner is not None and i < len(values):
            out[i:], inner = Smoother(self.alpha).run(inner, values[i:])
        return {self.outputs[0]: out}, (head, inner)


def before(last: float, x: np.ndarray) -> np.ndarray:
    """Each value's predecessor."""
    return np.append(last, x[:-1])


class Chain:
    """A kernel from a function that calls smoothers by name; their states are kept under those names."""

    def __init__(self, outputs: tuple[str, ...], made: Callable[[Any, Arrays], Arrays]):
        self.outputs, self.made = outputs, made

    def start(self) -> dict:
        return {}

    def run(self, state: dict, x: Arrays) -> tuple[Arrays, dict]:
        link = _Link(dict(state))
        made = self.made(link, x)
        return made, link.state


class _Link:
    def __init__(self, state: dict):
        self.state = state

    def smooth(self, name: str, smoother: Any, x: np.ndarray) -> np.ndarray:
        out, self.state[name] = smoother.run(self.state.get(name, smoother.start()), x)
        return out

    def prev(self, name: str, x: np.ndarray) -> np.ndarray:
        out = before(self.state.get(name, math.nan), x)
        if len(x):
            self.state[name] = float(x[-1])
        return out

    def seen(self, name: str, n: int) -> int:
        """Rows before this piece."""
        rows = self.state.get(name, 0)
        self.state[name] = rows + n
        return rows


def _ema(p: int, least: int | None = None) -> Smoother:
    return Smoother(2 / (p + 1), p if least is None else least)


def _range(link: _Link, x: Arrays, h: str, lo: str, c: str, first: bool = True) -> np.ndarray:
    last = link.prev("close", x[c])
    made = np.fmax(np.fmax(x[h] - x[lo], np.abs(x[h] - last)), np.abs(x[lo] - last))
    return made if first else np.where(np.isnan(last), np.nan, made)


def ema(x: str, p: int, out: str, least: int | None = None) -> Chain:
    return Chain((out,), lambda k, a: {out: k.smooth("e", _ema(p, least), a[x])})


def several_emas(x: str, windows: tuple[int, ...]) -> Chain:
    names = tuple(f"ema_{p}" for p in windows)
    return Chain(names, lambda k, a: {n: k.smooth(n, _ema(p, 1), a[x]) for n, p in zip(names, windows)})


def dema(x: str, p: int, out: str, third: bool = False) -> Chain:
    """Twice the average less the average of it (or the triple form). The inner warm-up is passed over, not carried into the outer averages."""

    def made(k: _Link, a: Arrays) -> Arrays:
        one = k.smooth("1", _ema(p), a[x])
        two = k.smooth("2", _ema(p), one)
        return {out: 3 * one - 3 * two + k.smooth("3", _ema(p), two) if third else 2 * one - two}

    return Chain((out,), made)


def macd(x: str, fast: int, slow: int, signal: int) -> Chain:
    def made(k: _Link, a: Arrays) -> Arrays:
        line = k.smooth("fast", _ema(fast), a[x]) - k.smooth("slow", _ema(slow), a[x])
        sign = k.smooth("signal", _ema(signal), line)
        return {"macd_line": line, "macd_signal": sign, "macd_histogram": line - sign}

    return Chain(("macd_line", "macd_signal", "macd_histogram"), made)


def rsi(x: str, p: int, out: str = "rsi") -> Chain:
    """Gains and losses start at 0, so the first value is 0 and none is absent."""

    def made(k: _Link, a: Arrays) -> Arrays:
        step = a[x] - k.prev("x", a[x])
        first = k.seen("n", len(step)) == 0
        if first and len(step):
            step[0] = 0.0
        up, down = (k.smooth(n, Smoother(1 / p), np.maximum(v, 0)) for n, v in (("up", step), ("down", -step)))
        return {out: 100 - 100 / (1 + up / (down + EPSILON))}

    return Chain((out,), made)


def atr(p: int, h: str = "high", lo: str = "low", c: str = "close", out: str = "atr") -> Chain:
    return Chain((out,), lambda k, a: {out: k.smooth("a", Smoother(1 / p), _range(k, a, h, lo, c))})


def atr_wilder(p: int, h: str = "high", lo: str = "low", c: str = "close", out: str = "atr_wilder") -> Chain:
    return Chain((out,), lambda k, a: {out: k.smooth("a", Wilder(p), _range(k, a, h, lo, c, first=False))})


def tsi(x: str, slow: int, fast: int, out: str = "tsi") -> Chain:
    def made(k: _Link, a: Arrays) -> Arrays:
        step = a[x] - k.prev("x", a[x])
        part = {n: k.smooth(f"{n}2", _ema(fast), k.smooth(f"{n}1", _ema(slow), v)) for n, v in (("m", step), ("a", np.abs(step)))}
        return {out: 100 * part["m"] / (part["a"] + EPSILON)}

    return Chain((out,), made)


def keltner(p: int, m: float, h: str = "high", lo: str = "low", c: str = "close") -> Chain:
    def made(k: _Link, a: Arrays) -> Arrays:
        middle, off = k.smooth("e", _ema(p, 1), a[c]), m * k.smooth("a", Smoother(1 / p), _range(k, a, h, lo, c))
        return {"kc_upper": middle + off, "kc_middle": middle, "kc_lower": middle - off}

    return Chain(("kc_upper", "kc_middle", "kc_lower"), made)


def adx(p: int, h: str = "high", lo: str = "low", c: str = "close") -> Chain:
    """Directional index: what is absent in the warm-up counts as 0 when the index itself is smoothed."""

    def made(k: _Link, a: Arrays) -> Arrays:
        up, down = a[h] - k.prev("h", a[h]), k.prev("l", a[lo]) - a[lo]
        absent = np.isnan(up)
        plus = np.where(absent, np.nan, np.where((up > down) & (up > 0), up, 0.0))
        minus = np.where(absent, np.nan, np.where((down > up) & (down > 0), down, 0.0))
        true = k.smooth("t", Wilder(p), _range(k, a, h, lo, c, first=False)) + EPSILON
        plus, minus = (100 * k.smooth(n, Wilder(p), v) / true for n, v in (("+", plus), ("-", minus)))
        total = plus + minus
        index = np.where(total > EPSILON, 100 * np.abs(plus - minus) / np.where(total > EPSILON, total + EPSILON, 1.0), 0.0)
        return {"adx": np.clip(k.smooth("x", Wilder(p), index), 0, 100), "plus_di": np.clip(plus, 0, 100), "minus_di": np.clip(minus, 0, 100)}

    return Chain(("adx", "plus_di", "minus_di"), made)


class ParabolicSar:
    outputs = ("sar",)

    def __init__(self, start: float, step: float, most: float, h: str = "high", lo: str = "low"):
        self.first, self.step, self.most, self.h, self.lo = start, step, most, h, lo

    def start(self) -> tuple | None:
        return None

    def run(self, state: tuple | None, x: Arrays) -> tuple[Arrays, tuple | None]:
        out = []
        for high, low in zip(x[self.h].tolist(), x[self.lo].tolist()):
            if math.isnan(high) or math.isnan(low):
                out.append(math.nan)
                continue
            if state is None:
                sar, extreme, rising, speed, lows, highs = low, high, True, self.first, (low,), (high,)
            else:
                sar, extreme, rising, speed, lows, highs = state
                sar += speed * (extreme - sar)
                sar = min(sar, *lows) if rising else max(sar, *highs)
                if low < sar if rising else high > sar:
                    sar, extreme, rising, speed = extreme, low if rising else high, not rising, self.first
                elif high > extreme if rising else low < extreme:
                    extreme, speed = high if rising else low, min(speed + self.step, self.most)
                lows, highs = (lows[-1], low), (highs[-1], high)
            state = (sar, extreme, rising, speed, lows, highs)
            out.append(sar)
        return {"sar": np.array(out)}, state


class Supertrend:
    outputs = ("supertrend", "trend")

    def __init__(self, p: int, m: float, h: str = "high", lo: str = "low", c: str = "close"):
        self.p, self.m, self.h, self.lo, self.c = p, m, h, lo, c
        self.atr = atr(p, h, lo, c)

    def start(self) -> tuple:
        return (self.atr.start(), 0, None)

    def run(self, state: tuple, x: Arrays) -> tuple[Arrays, tuple]:
        inner, row, held = state
        made, inner = self.atr.run(inner, x)
        middle, off = (x[self.h] + x[self.lo]) / 2, self.m * made["atr"]
        line, trend = np.full(len(middle), np.nan), np.full(len(middle), np.nan)
        for i, (top, bottom, close) in enumerate(zip((middle + off).tolist(), (middle - off).tolist(), x[self.c].tolist())):
            row += 1
            if row <= self.p or math.isnan(top) or math.isnan(close):
                continue
            if held is None:
                way = -1 if close <= top else 1
            else:
                was_top, was_bottom, was_close, way = held
                bottom = bottom if bottom > was_bottom or was_close < was_bottom else was_bottom
                top = top if top < was_top or was_close > was_top else was_top
                if way == 1 and close <= bottom:
                    way = -1
                elif way == -1 and close >= top:
                    way = 1
            held = (top, bottom, close, way)
            line[i], trend[i] = bottom if way == 1 else top, way
        return {"supertrend": line, "trend": trend}, (inner, row, held)


class Aroon:
    """How long ago the greatest high and the least low of the last n rows were; of equal ones the latest. Holds n - 1 rows."""

    outputs = ("aroon_up", "aroon_down")

    def __init__(self, n: int, high: str, low: str):
        self.n, self.columns = n, (high, low)

    def start(self) -> tuple:
        return (np.empty(0), np.empty(0))

    def _ages(self, x: np.ndarray, rows: int) -> np.ndarray:
        """100 (n - age) / n of the greatest of each n rows, absent where one of them is."""
        out = np.full(rows, np.nan)
        if len(x) >= self.n:
            # newest first, so that the first of equal values is the latest
            window = np.lib.stride_tricks.sliding_window_view(x, self.n)[:, ::-1]
            made = (self.n - np.argmax(window, axis=1)) * 100.0 / self.n
            made[np.isnan(window).any(axis=1)] = np.nan
            out[rows - len(made) :] = made
        return out

    def run(self, state: tuple, x: Arrays) -> tuple[Arrays, tuple]:
        high, low = (np.append(held, x[c]) for held, c in zip(state, self.columns))
        rows = len(x[self.columns[0]])
        made = {"aroon_up": self._ages(high, rows), "aroon_down": self._ages(-low, rows)}
        keep = self.n - 1
        return made, (high[len(high) - keep :] if keep and len(high) > keep else high[:keep], low[len(low) - keep :] if keep and len(low) > keep else low[:keep])


class Windowed:
    """A column over the last n rows, for streams: ``made`` takes a matrix of n columns, one row of values each. Absent until n rows are there."""

    def __init__(self, x: str, n: int, made: Callable[[np.ndarray], np.ndarray], out: str):
        self.x, self.n, self.made, self.outputs = x, n, made, (out,)

    def start(self) -> np.ndarray:
        return np.empty(0)

    def run(self, state: np.ndarray, x: Arrays) -> tuple[Arrays, np.ndarray]:
        whole, rows = np.append(state, x[self.x]), len(x[self.x])
        out = np.full(rows, np.nan)
        if len(whole) >= self.n:
            made = self.made(np.lib.stride_tricks.sliding_window_view(whole, self.n))
            out[rows - len(made) :] = made
        return {self.outputs[0]: out}, whole[max(0, len(whole) - self.n + 1) :]


def sma(x: str, n: int, out: str = "sma") -> Windowed:
    return Windowed(x, n, lambda w: w.mean(axis=1), out)


def rolling_extreme(x: str, n: int, greatest: bool, out: str) -> Windowed:
    return Windowed(x, n, lambda w: w.max(axis=1) if greatest else w.min(axis=1), out)


def rolling_std(x: str, n: int, out: str) -> Windowed:
    return Windowed(x, n, lambda w: w.std(axis=1, ddof=1), out)


def wma(x: str, n: int, out: str = "wma") -> Windowed:
    weights = np.arange(1, n + 1) / (n * (n + 1) / 2)
    return Windowed(x, n, lambda w: w @ weights, out)


def roc(x: str, n: int, out: str = "roc") -> Windowed:
    return Windowed(x, n + 1, lambda w: np.divide((w[:, -1] - w[:, 0]) * 100, w[:, 0], out=np.full(len(w), np.nan), where=w[:, 0] != 0), out)
