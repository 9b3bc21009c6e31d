"""Pixel coordinates of chart marks, as relational expressions over candles.

A series is a chart. Where all prices are equal or there is no volume, marks lie at the bottom (height 0)
instead of failing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Series
from .style import BOX, CHART_PART, GRID_COLUMNS, GRID_ROWS, SPACING, TICK, VOLUME_PART


def _placed(df: DataFrame, s: Series, low: str, high: str, volume: str | None) -> DataFrame:
    """row (0-based), _n rows, price bounds and greatest volume of each chart."""
    bounds = [F.count(F.lit(1)).alias("_n"), F.min(low).alias("_low"), F.max(high).alias("_high")]
    by = df.groupBy(*s.keys).agg(*bounds, *([F.max(volume).alias("_top")] if volume else []))
    # one row for each chart
    rows = df.withColumn("row", F.row_number().over(s.w) - 1)
    if not s.keys:
        return rows.crossJoin(F.broadcast(by))
    named = F.struct(*s.keys)
    return rows.withColumn("_id", named).join(by.select(named.alias("_id"), *by.columns[len(s.keys) :]), "_id").drop("_id")


def _int(c: Column) -> Column:
    return c.cast("long")


def _y(price: str, height: int) -> Column:
    share = F.coalesce(F.try_divide(F.col(price) - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0))
    return _int(F.lit(height) - share * height)


def _volume(volume: str, height: int) -> Column:
    return _int(F.coalesce(F.try_divide(F.col(volume).cast("double"), F.col("_top").cast("double")), F.lit(0.0)) * height)


def candles(df: DataFrame, s: Series, width: int = 1920, height: int = 1080) -> DataFrame:
    """keys, row, x_start, x_end, x_center, y_high, y_low, y_open, y_close, body_top, body_bottom, volume_height, bullish."""
    slot = F.lit(float(width)) / (F.col("_n") + 1)
    rows = _placed(df, s, "low", "high", "volume").withColumn("_slot", slot)
    bar = F.col("_slot") - F.col("_slot") * SPACING
    rows = rows.withColumn("x_start", _int(F.col("row") * F.col("_slot") + F.col("_slot") * SPACING / 2))
    ys = {f"y_{c}": _y(c, int(height * CHART_PART)) for c in ("high", "low", "open", "close")}
    rows = rows.withColumns({"x_end": _int(F.col("x_start") + bar), "x_center": _int(F.col("x_start") + bar / 2), **ys, "volume_height": _volume("volume", int(height * VOLUME_PART)), "bullish": F.col("close") >= F.col("open")})
    return rows.select(*s.keys, F.col("row").cast("long").alias("row"), "x_start", "x_end", "x_center", *ys, F.least("y_open", "y_close").alias("body_top"), F.greatest("y_open", "y_close").alias("body_bottom"), "volume_height", "bullish")


def ohlc_bars(df: DataFrame, s: Series, width: int = 1920, height: int = 1080) -> DataFrame:
    """keys, row, x_center, x_left, x_right, y_*, volume_start, volume_end, volume_height, bullish."""
    slot = F.lit(float(width)) / (F.col("_n") + 1)
    rows = _placed(df, s, "low", "high", "volume").withColumn("_slot", slot).withColumn("x_center", _int((F.col("row") + 0.5) * F.col("_slot")))
    ys = {f"y_{c}": _y(c, int(height * CHART_PART)) for c in ("high", "low", "open", "close")}
    made = {"x_left": _int(F.col("x_center") - F.col("_slot") * TICK), "x_right": _int(F.col("x_center") + F.col("_slot") * TICK), **ys, "volume_start": _int((F.col("row") + 0.25) * F.col("_slot")), "volume_end": _int((F.col("row") + 0.75) * F.col("_slot")), "volume_height": _volume("volume", int(height * VOLUME_PART)), "bullish": F.col("close") >= F.col("open")}
    return rows.withColumns(made).select(*s.keys, F.col("row").cast("long").alias("row"), "x_center", *made)


def line(df: DataFrame, s: Series, width: int = 1920, height: int = 1080) -> DataFrame:
    """keys, row, x, y, volume_start, volume_end, volume_height; the price bounds are those of the close."""
    slot = F.lit(float(width)) / (F.col("_n") + 1)
    rows = _placed(df, s, "close", "close", "volume").withColumn("_slot", slot)
    rows = rows.withColumns({"x": _int((F.col("row") + 0.5) * F.col("_slot")), "y": _y("close", int(height * CHART_PART)), "volume_start": _int(F.col("row") * F.col("_slot") + F.col("_slot") * SPACING / 2)})
    rows = rows.withColumns({"volume_end": _int(F.col("volume_start") + F.col("_slot") * (1 - SPACING)), "volume_height": _volume("volume", int(height * VOLUME_PART))})
    return rows.select(*s.keys, F.col("row").cast("long").alias("row"), "x", "y", "volume_start", "volume_end", "volume_height")


def grid(df: DataFrame, s: Series, width: int = 1920, height: int = 1080) -> DataFrame:
    """keys, x1, y1, x2, y2 of the grid lines of each chart."""
    top = int(height * CHART_PART)
    counts = df.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("_n"))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / GRID_COLUMNS))
    across = counts.select(*s.keys, F.explode(F.sequence(F.lit(1), F.lit(GRID_ROWS - 1))).alias("_i")).select(*s.keys, F.lit(0).cast("long").alias("x1"), _int(F.floor(F.col("_i") * top / GRID_ROWS)).alias("y1"), F.lit(width).cast("long").alias("x2"), _int(F.floor(F.col("_i") * top / GRID_ROWS)).alias("y2"))
    down = counts.select(*s.keys, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, step.cast("long"))).alias("_i"))
    x = _int(F.col("_i") * (F.lit(float(width)) / (F.col("_n") + 1)))
    return across.unionByName(down.select(*s.keys, x.alias("x1"), F.lit(0).cast("long").alias("y1"), x.alias("x2"), F.lit(top).cast("long").alias("y2")))


def _by_key(rows: DataFrame, s: Series, *made: Column) -> DataFrame:
    """Adds aggregates of each chart to its rows."""
    named = F.struct(*s.keys) if s.keys else F.lit(0)
    by = rows.groupBy(named.alias("_id")).agg(*made)
    return rows.withColumn("_id", named).join(by, "_id").drop("_id")


def renko_boxes(bricks: DataFrame, s: Series, box: float, width: int = 1920, height: int = 1080) -> DataFrame:
    """From Renko bricks (keys, brick, price, direction) of one box size: keys, brick, x_start, x_end, y_start, y_end, direction."""
    tall = int(height * CHART_PART)
    rows = _by_key(bricks, s, F.count(F.lit(1)).alias("_n"), (F.min("price") - box).alias("_low"), (F.max("price") + box).alias("_high"))
    slot = F.lit(float(width)) / (F.col("_n") + 1)
    deep = F.greatest(_int(F.lit(float(box)) / (F.col("_high") - F.col("_low")) * tall), F.lit(1).cast("long"))
    rows = rows.withColumns({"x_start": _int(F.col("brick") * slot + slot * SPACING / 2), "y_start": _y("price", tall)})
    rows = rows.withColumns({"x_end": _int(F.col("x_start") + slot * (1 - SPACING)), "y_end": F.when(F.col("direction") > 0, F.col("y_start") + deep).otherwise(F.col("y_start") - deep)})
    return rows.select(*s.keys, F.col("brick").cast("long").alias("brick"), "x_start", "x_end", "y_start", "y_end", "direction")


def point_and_figure_boxes(boxes: DataFrame, s: Series, box: float, width: int = 1920, height: int = 1080) -> DataFrame:
    """From boxes of columns (keys, column, type, position, price) of one box size: keys, column, position, type, x_center, y_center, half_width, half_height."""
    rows = _by_key(boxes, s, (F.max("column") + 1).alias("_n"), (F.min("price") - box).alias("_low"), (F.max("price") + box).alias("_high"))
    slot = F.lit(float(width)) / (F.col("_n") + 1)
    deep = F.greatest(_int(F.lit(float(box)) / (F.col("_high") - F.col("_low")) * height), F.lit(10).cast("long"))
    return rows.select(
        *s.keys, "column", F.col("position").cast("long").alias("position"), "type",
        _int(_int(F.col("column") * slot) + slot / 2).alias("x_center"), _y("price", height).alias("y_center"),
        _int(F.floor(_int(slot * BOX) / 2)).alias("half_width"), _int(F.floor(deep / 2)).alias("half_height"),
    )
