"""Running totals of series of any length.

A window over a whole series runs in one task. Here a series is cut by time: totals of each chunk come
from an aggregation, the totals before a chunk from a window over chunks, and the running total within
a chunk from a window over its rows. So a hot series is spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Series, need


def running_totals(df: DataFrame, s: Series, totals: dict[str, Column]) -> DataFrame:
    """``df`` with a column for each of ``totals``: the sum of its values from the series' first row to this one. Nulls count as nothing."""
    need(df, *s.keys, *s.order)
    values = {f"_v_{n}": F.coalesce(c, F.lit(0)) for n, c in totals.items()}
    rows = df.withColumns(values)
    if s.chunk is None:
        return rows.withColumns({n: F.sum(f"_v_{n}").over(s.running) for n in totals}).drop(*values)
    # one column names a chunk, nulls among the keys included, so that the window and the join share one exchange
    rows = _chunked(rows, s)
    whole = rows.groupBy(*s.keys, "_chunk", "_id").agg(*[F.sum(v).alias(v) for v in values])
    before = Window.partitionBy(*s.keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ahead = whole.select("_id", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_b{v}") for v in values])
    inside = Window.partitionBy("_id").orderBy(*s.order).rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumns({f"_in_{n}": F.sum(f"_v_{n}").over(inside) for n in totals})
    return within.join(ahead, "_id").withColumns({n: F.col(f"_b_v_{n}") + F.col(f"_in_{n}") for n in totals}).select(*df.columns, *totals)


def _chunked(rows: DataFrame, s: Series) -> DataFrame:
    """Adds ``_chunk`` and ``_id``, which tells chunks of all series apart."""
    made = rows.withColumn("_chunk", F.date_trunc(s.chunk, F.col(s.order[0]).cast("timestamp")))
    return made.withColumn("_id", F.struct(*s.keys, "_chunk"))


def cumulative_sum(df: DataFrame, s: Series, x: str, out: str = "cumulative") -> DataFrame:
    return running_totals(df, s, {out: F.col(x)})


def obv(df: DataFrame, s: Series, close: str = "close", volume: str = "volume", out: str = "obv") -> DataFrame:
    """On-balance volume: the signed volume so far, 0 at the first row."""
    value = F.signum(F.col(close) - F.col("_was")) * F.col(volume)
    made = previous(df, s, close, "_was")
    return running_totals(made.withColumn("_step", F.coalesce(value, F.lit(0.0))), s, {out: F.col("_step")}).select(*df.columns, out)


def previous(df: DataFrame, s: Series, x: str, out: str) -> DataFrame:
    """The value of the row before: within a chunk by a window, at its first row the last value of the chunk before."""
    if s.chunk is None:
        return df.withColumn(out, s.prev(x))
    need(df, *s.keys, *s.order)
    rows = _chunked(df, s)
    last = rows.groupBy(*s.keys, "_chunk", "_id").agg(F.max_by(F.struct(F.col(x).alias("x")), F.struct(*s.order)).alias("_last"))
    ahead = last.select("_id", F.lag("_last").over(Window.partitionBy(*s.keys).orderBy("_chunk"))["x"].alias("_ahead"))
    inside = Window.partitionBy("_id").orderBy(*s.order)
    within = rows.withColumns({"_first": F.row_number().over(inside) == 1, "_lag": F.lag(x).over(inside)})
    return within.join(ahead, "_id").withColumn(out, F.when(F.col("_first"), F.col("_ahead")).otherwise(F.col("_lag"))).select(*df.columns, out)


def vwap(df: DataFrame, s: Series, high: str = "high", low: str = "low", close: str = "close", volume: str = "volume", out: str = "vwap") -> DataFrame:
    """Volume-weighted average of the typical price since the series began."""
    typical = (F.col(high) + F.col(low) + F.col(close)) / 3
    rows = running_totals(df, s, {"_pv": typical * F.col(volume), "_v": F.col(volume)})
    return rows.withColumn(out, F.try_divide(F.col("_pv").cast("double"), F.col("_v").cast("double"))).drop("_pv", "_v")


def vwap_anchored(df: DataFrame, s: Series, anchor: str, high: str = "high", low: str = "low", close: str = "close", volume: str = "volume", out: str = "vwap") -> DataFrame:
    """The same since the last row whose ``anchor`` is true or 1."""
    rows = running_totals(df, s, {"_session": F.coalesce(F.col(anchor).cast("int"), F.lit(0)).cast("long")})
    return vwap(rows, Series((*s.keys, "_session"), s.order, s.chunk), high, low, close, volume, out).drop("_session")
