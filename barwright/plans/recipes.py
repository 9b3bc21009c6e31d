"""What users build from the operators, each as one lazy plan."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..charts import draw
from ..charts.style import Style
from ..errors import ConfigurationError, period
from ..functions.rowwise import broken_candle
from ..model import Series
from ..operators import recursive, rolling, totals

DASHBOARD = ("rsi", "atr", "macd_line", "macd_signal", "obv")
#: Rows of a chart at most, the last ones; a chart of pixels shows no more.
CHART_ROWS = 2000


def last_rows(df: DataFrame, s: Series, n: int) -> DataFrame:
    """The last n rows of each series."""
    period(n=n)
    back = Window.partitionBy(*s.keys).orderBy(*[F.desc(c) for c in s.order])
    return df.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= n).drop("_back")


def broken_rows(df: DataFrame) -> DataFrame:
    """Candles whose prices contradict each other."""
    return df.where(broken_candle())


def dashboard(df: DataFrame, s: Series) -> DataFrame:
    """The last value of each headline indicator by series."""
    last = F.max_by(F.struct(*DASHBOARD), F.struct(*s.order)).alias("_last")
    return recursive.indicators_batch(df, s).groupBy(*s.keys).agg(last).select(*s.keys, "_last.*")


def enrich(df: DataFrame, s: Series, path: str) -> None:
    """Candles with the batch's indicators, written as Parquet."""
    recursive.indicators_batch(df, s).write.mode("overwrite").option("compression", "zstd").parquet(path)


#: Lines, bars and levels of each panel that ``charts`` can draw, from columns of the same names.
PANELS = {
    "rsi": (("rsi",), None, (30.0, 70.0), (0.0, 100.0)),
    "macd": (("macd_line", "macd_signal"), "macd_histogram", (), None),
    "stochastic": (("stoch_k", "stoch_d"), None, (20.0, 80.0), (0.0, 100.0)),
    "atr": (("atr",), None, (), None),
    "obv": (("obv",), None, (), None),
}


def with_indicators(df: DataFrame, s: Series, sma: tuple[int, ...] = (), ema: tuple[int, ...] = (), panels: tuple[str, ...] = ()) -> DataFrame:
    """Candles with sma_n, ema_n and the columns of the panels, over whole series."""
    if unknown := set(panels) - set(PANELS):
        raise ConfigurationError(f"unknown panels: {', '.join(sorted(unknown))}")
    rows = recursive.multiple_averages(df, s, "close", sma, ema) if sma or ema else df
    made = {"rsi": recursive.rsi, "macd": recursive.macd, "stochastic": rolling.stochastic, "atr": recursive.atr, "obv": totals.obv}
    for name in panels:
        rows = made[name](rows, s)
    return rows


def charts(df: DataFrame, s: Series, form: str = "png", kind: str = "candle", style: Style | None = None, rows: int | None = CHART_ROWS, sma: tuple[int, ...] = (), ema: tuple[int, ...] = (), panels: tuple[str, ...] = (), speed: str = "balanced") -> DataFrame:
    """keys and ``image``: a chart of the last rows of each series (None: all), drawn in parallel by series.

    Averages are drawn over the prices, panels (``PANELS``) below them; they are computed over whole series before rows are cut.
    """
    style = style or Style(width=640, height=360)
    lines = [f"sma_{n}" for n in sma] + [f"ema_{n}" for n in ema]
    nothing = {c: np.empty(0) for c in ("open", "high", "low", "close")}
    draw.render(nothing, kind, form, style, speed=speed)  # parameter errors now, not in a task
    whole = with_indicators(df, s, sma, ema, panels)
    kept = last_rows(whole, s, rows) if rows else whole
    shape = ", ".join([f"{k} {df.schema[k].dataType.simpleString()}" for k in s.keys] + ["image binary"])
    order = list(s.order)

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        values = lambda c: part[c].to_numpy(dtype=float, na_value=np.nan)
        strips = [draw.Panel({c: values(c) for c in names}, values(bars) if bars else None, levels, bounds) for names, bars, levels, bounds in (PANELS[p] for p in panels)]
        image = draw.render({c: part[c].to_numpy() for c in ("open", "high", "low", "close", "volume") if c in part}, kind, form, style, overlays={c: values(c) for c in lines}, panels=strips, speed=speed)
        return pd.DataFrame([[*key, image]])

    return kept.groupBy(*s.keys).applyInPandas(one, shape)
