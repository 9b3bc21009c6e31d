"""Bars and bricks as table functions of SQL: ``SELECT * FROM renko(TABLE(candles) PARTITION BY (symbol) ORDER BY (ts), 2.0, 1)``.

Spark brings each partition's rows in order; the emitters that the DataFrame operators use make the rows, so both
give the same. A partition is one series; its key, the first column of the table, is given with each row as a string. Rows are
taken in pieces of bounded size. Columns go by their names: ts, price and volume of ticks, high, low and close of candles.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from ..errors import ConfigurationError
from ..operators import bars, bricks

PIECE = 4096
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _number(v: object) -> float:
    if isinstance(v, datetime):
        known = v if v.tzinfo else v.astimezone()
        since = known - _EPOCH
        return (since.days * 86_400 + since.seconds) * 1_000_000 + since.microseconds
    return np.nan if v is None else v


class _Table:
    """Feeds an emitter; ``columns`` of the row, and ``extra`` values that are the same in all rows."""

    columns: tuple[str, ...] = ()
    extra: dict[str, float] = {}

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.key: str | None = None
        self.emitter = self.state = None

    def _made(self, *parameters: float) -> object:
        raise NotImplementedError

    def eval(self, row: Row, *parameters: float) -> Iterator[tuple]:
        if self.emitter is None:
            self.emitter = self._made(*parameters)
            self.state, self.key = self.emitter.start(), None if row[0] is None else str(row[0])
        self.rows.append(tuple(_number(row[c]) for c in self.columns))
        if len(self.rows) >= PIECE:
            yield from self._run()

    def _run(self) -> list[tuple]:
        x = {c: np.array(v, float if c != "ts" else "i8") for c, v in zip(self.columns, zip(*self.rows))}
        x |= {c: np.full(len(self.rows), v) for c, v in self.extra.items()}
        self.rows = []
        found, self.state = self.emitter.run(self.state, x)
        return [(self.key, *r) for r in found]

    def terminate(self) -> Iterator[tuple]:
        if self.emitter is not None:
            if self.rows:
                yield from self._run()
            yield from [(self.key, *r) for r in self.emitter.finish(self.state)]


class _Ticks(_Table):
    columns = ("ts", "price", "volume")


class _Candles(_Table):
    columns = ("high", "low", "close")

    def _boxed(self, box: float) -> None:
        if not box > 0:
            raise ConfigurationError(f"box must be positive, got {box}")
        self.extra = {"box": float(box)}


class RangeBarsTable(_Ticks):
    def _made(self, size: float) -> bars.RangeBars:
        return bars.RangeBars(float(size), *self.columns)


class KagiTable(_Ticks):
    def _made(self, amount: float) -> bars.KagiLines:
        return bars.KagiLines(float(amount), None, *self.columns)


class LineBreakTable(_Ticks):
    def _made(self, lines: int = 3) -> bars.LineBreak:
        return bars.LineBreak(int(lines), False, *self.columns)


class RenkoTable(_Candles):
    def _made(self, box: float, reversal: int = 1) -> bricks.Bricks:
        self._boxed(box)
        return bricks.Bricks("box", int(reversal), *self.columns)


class PointAndFigureTable(_Candles):
    def _made(self, box: float, reversal: int = 3) -> bricks.Columns:
        self._boxed(box)
        return bricks.Columns("box", int(reversal), *self.columns)


TABLES = {
    "range_bars": (RangeBarsTable, bars.RangeBars),
    "kagi": (KagiTable, bars.KagiLines),
    "three_line_break": (LineBreakTable, bars.LineBreak),
    "renko": (RenkoTable, bricks.Bricks),
    "point_and_figure": (PointAndFigureTable, bricks.Columns),
}


def register(spark: SparkSession) -> list[str]:
    """Make the table functions known to SQL in this session; their names."""
    for name, (table, emitter) in TABLES.items():
        shape = "key string, " + ", ".join(f"`{n}` {kind}" for n, kind in emitter.fields)
        spark.udtf.register(name, udtf(table, returnType=shape))
    return list(TABLES)
