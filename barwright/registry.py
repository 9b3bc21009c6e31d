"""All operators by name: what they read, what they add, and how they run."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from .errors import ConfigurationError
from .model import Series, need
from .operators import bars, bricks, recursive, rolling, totals

#: Names of parameters that are columns.
COLUMNS = ("x", "high", "low", "close", "volume", "price")


@dataclass(frozen=True)
class Operator:
    """kind: ``window`` (built-in functions), ``totals`` (two-level sums), ``pass`` (one ordered pass) or ``bars`` (other rows come out)."""

    name: str
    call: Callable[..., DataFrame]
    kind: str
    outputs: tuple[str, ...]

    @property
    def parameters(self) -> dict[str, Any]:
        """With their defaults; ``inspect.Parameter.empty`` where one must be given."""
        return {n: p.default for n, p in list(inspect.signature(self.call).parameters.items())[2:]}

    @property
    def inputs(self) -> tuple[str, ...]:
        return tuple(v for n, v in self.parameters.items() if n in COLUMNS and isinstance(v, str))

    def __call__(self, df: DataFrame, s: Series, strict: bool = False, **parameters: Any) -> DataFrame:
        """``strict``: a series with fewer rows than the longest window is an error, not a column of nulls; that counts rows at once."""
        if unknown := set(parameters) - set(self.parameters):
            raise ConfigurationError(f"{self.name} has no parameters {', '.join(sorted(unknown))}")
        chosen = self.parameters | parameters
        need(df, *s.keys, *s.order, *[chosen[n] for n in COLUMNS if isinstance(chosen.get(n), str)])
        if strict:
            from .errors import enough_rows

            spans = [v for n, v in chosen.items() if n not in COLUMNS and isinstance(v, int) and not isinstance(v, bool)]
            enough_rows(df, s.keys, max(spans, default=1))
        return self.call(df, s, **parameters)


_OHLCV = ("ts", "open", "high", "low", "close", "volume")
OPERATORS: dict[str, Operator] = {
    o.name: o
    for o in (
        *(
            Operator(f.__name__, f, "window", out)
            for f, out in (
                (rolling.sma, ("sma",)),
                (rolling.wma, ("wma",)),
                (rolling.vwma, ("vwma",)),
                (rolling.hma, ("hma",)),
                (rolling.ichimoku, ("tenkan", "kijun", "senkou_a", "senkou_b", "chikou")),
                (rolling.stochastic, ("stoch_k", "stoch_d")),
                (rolling.williams_r, ("williams_r",)),
                (rolling.cci, ("cci",)),
                (rolling.roc, ("roc",)),
                (rolling.mfi, ("mfi",)),
                (rolling.bollinger, ("bb_upper", "bb_middle", "bb_lower")),
                (rolling.donchian, ("dc_upper", "dc_middle", "dc_lower")),
                (rolling.cmf, ("cmf",)),
                (rolling.swing_points, ("swing_high", "swing_low")),
                (rolling.moving_linear_fit, ("fit_slope", "fit_intercept")),
            )
        ),
        *(Operator(f.__name__, f, "totals", (out,)) for f, out in ((totals.cumulative_sum, "cumulative"), (totals.obv, "obv"), (totals.vwap, "vwap"), (totals.vwap_anchored, "vwap"))),
        *(
            Operator(f.__name__, f, "pass", out)
            for f, out in (
                (rolling.aroon, ("aroon_up", "aroon_down")),
                (recursive.ema, ("ema",)),
                (recursive.ewm_mean, ("ewm",)),
                (recursive.wilder, ("wilder",)),
                (recursive.dema, ("dema",)),
                (recursive.tema, ("tema",)),
                (recursive.macd, ("macd_line", "macd_signal", "macd_histogram")),
                (recursive.rsi, ("rsi",)),
                (recursive.stochastic_rsi, ("stoch_rsi_k", "stoch_rsi_d")),
                (recursive.atr, ("atr",)),
                (recursive.atr_wilder, ("atr_wilder",)),
                (recursive.tsi, ("tsi",)),
                (recursive.elder_ray, ("bull_power", "bear_power")),
                (recursive.keltner, ("kc_upper", "kc_middle", "kc_lower")),
                (recursive.adx, ("adx", "plus_di", "minus_di")),
                (recursive.parabolic_sar, ("sar",)),
                (recursive.supertrend, ("supertrend", "trend")),
                (recursive.indicators_batch, ("atr", "rsi", "stoch_k", "stoch_d", "bb_upper", "bb_middle", "bb_lower", "obv", "macd_line", "macd_signal", "macd_histogram")),
            )
        ),
        *(Operator(f.__name__, f, "bars", _OHLCV) for f in (bars.time_bars, bars.ohlc_resample, bars.tick_bars, bars.volume_bars, bars.range_bars, bars.kagi, bars.three_line_break)),
        Operator("renko", bricks.renko, "bars", ("brick", "price", "direction", "row")),
        Operator("point_and_figure", bricks.point_and_figure, "bars", ("column", "type", "boxes", "start_idx")),
    )
}


def operator(name: str) -> Operator:
    if name not in OPERATORS:
        raise ConfigurationError(f"unknown operator {name!r}")
    return OPERATORS[name]


def apply(name: str, df: DataFrame, s: Series, **parameters: Any) -> DataFrame:
    return operator(name)(df, s, **parameters)
