"""Renko bricks and point-and-figure columns from candles."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import period, positive
from ..model import Series
from .recursive import atr
from .scan import emit

Arrays = dict[str, np.ndarray]


class Bricks:
    """A candle's high is looked at first and, if it makes bricks, alone; else its low. A turn needs ``reversal`` boxes.

    A candle's bricks lie at multiples of the box from the level before it: box by box, roundings would add up.
    """

    fields = (("brick", "long"), ("price", "double"), ("direction", "int"), ("row", "long"))

    def __init__(self, box: str, reversal: int, high: str, low: str, close: str):
        self.box, self.reversal, self.columns = box, reversal, (high, low, close)

    def start(self) -> tuple:
        return (None, 0, 0, 0)

    def run(self, state: tuple, x: Arrays) -> tuple[list[tuple], tuple]:
        level, way, number, row = state
        out = []
        for high, low, close, box in zip(*(x[c].tolist() for c in (*self.columns, self.box))):
            row += 1
            if math.isnan(high) or math.isnan(low) or math.isnan(close) or not box > 0:
                continue
            if level is None:
                level = close
            for side, reach in ((1, high - level), (-1, level - low)):
                boxes = int(reach / box) if reach >= box else 0
                if not boxes or (way == -side and boxes < self.reversal):
                    continue
                was = level
                for n in range(1, boxes + 1):
                    level = was + side * box * n
                    out.append((number, level, side, row - 1))
                    number += 1
                way = side
                break
        return out, (level, way, number, row)

    def finish(self, state: tuple) -> list[tuple]:
        return []


class Columns:
    """X columns rise and O columns fall box by box; a turn needs ``reversal`` boxes and starts from the column's last box."""

    fields = (("column", "long"), ("type", "string"), ("boxes", "array<double>"), ("start_idx", "long"))

    def __init__(self, box: str, reversal: int, high: str, low: str, close: str):
        self.box, self.reversal, self.inputs = box, reversal, (high, low, close)

    def start(self) -> dict:
        return {"level": None, "way": 0, "boxes": [], "at": 0, "row": 0, "number": 0}

    def _close(self, s: dict) -> list[tuple]:
        made = [(s["number"], "X" if s["way"] > 0 else "O", s["boxes"], s["at"])] if s["boxes"] else []
        s["number"] += len(made)
        return made

    def run(self, s: dict, x: Arrays) -> tuple[list[tuple], dict]:
        out = []
        for high, low, close, box in zip(*(x[c].tolist() for c in (*self.inputs, self.box))):
            row = s["row"]
            s["row"] += 1
            if math.isnan(high) or math.isnan(low) or math.isnan(close) or not box > 0:
                continue
            if s["level"] is None:
                s["level"] = round(close / box) * box
            up, down = int((high - s["level"]) / box), int((s["level"] - low) / box)
            way = s["way"] or 1  # before the first column the price is looked at as if rising
            ahead, back = (up, down) if way > 0 else (down, up)
            if ahead > 0:
                if not s["way"]:
                    s["way"], s["at"] = 1, row
                count = ahead
            elif back >= self.reversal:
                out += self._close(s)
                s["way"], s["boxes"], s["at"] = -way, [], row
                count = back
            else:
                continue
            for _ in range(count):
                s["level"] += s["way"] * box
                s["boxes"].append(s["level"])
        return out, s

    def finish(self, s: dict) -> list[tuple]:
        return self._close(s)


def _with_box(df: DataFrame, s: Series, box: float | None, share: float, short: bool, columns: tuple[str, str, str]) -> DataFrame:
    """``_box`` by series: as given, else ``share`` of the median range average; short series may fall back to 1 % of their range."""
    if box is not None:
        positive(box=box)
        return df.withColumn("_box", F.lit(float(box)))
    high, low, close = columns
    ranged = atr(df, s, 14, high, low, close, "_atr")
    by = ranged.groupBy(*s.keys).agg((F.median("_atr") * share).alias("_box"), F.count(F.lit(1)).alias("_rows"), (F.max(high) - F.min(low)).alias("_range"))
    if short:
        by = by.withColumn("_box", F.when(F.col("_rows") >= 14, F.col("_box")).when(F.col("_range") > 0, F.col("_range") * 0.01).otherwise(1.0))
    by = by.drop("_rows", "_range")
    # one row per series; without keys, one row in all
    return df.join(by, list(s.keys)) if s.keys else df.crossJoin(F.broadcast(by))


def renko(df: DataFrame, s: Series, box: float | None = None, reversal: int = 1, high: str = "high", low: str = "low", close: str = "close") -> DataFrame:
    """keys, brick, price, direction, row (0-based candle). The box defaults to 0.75 of the median ATR(14); a box that is not positive makes no bricks."""
    period(reversal=reversal)
    rows = _with_box(df, s, box, 0.75, False, (high, low, close))
    return emit(rows, s, [high, low, close, "_box"], Bricks("_box", reversal, high, low, close))


def point_and_figure(df: DataFrame, s: Series, box: float | None = None, reversal: int = 3, high: str = "high", low: str = "low", close: str = "close") -> DataFrame:
    """keys, column, type (X or O), boxes, start_idx. The box defaults to the median ATR(14), or to 1 % of the range of series under 14 rows."""
    period(reversal=reversal)
    rows = _with_box(df, s, box, 1.0, True, (high, low, close))
    return emit(rows, s, [high, low, close, "_box"], Columns("_box", reversal, high, low, close))


def exploded(columns: DataFrame, s: Series) -> DataFrame:
    """A row for each box of point-and-figure columns: keys, column, type, start_idx, position, price."""
    return columns.select(*s.keys, "column", "type", "start_idx", F.posexplode("boxes").alias("position", "price"))


