"""Structured Streaming: time bars by watermark, and the batch kernels with their state kept by series.

A series' state is the kernel's state, pickled, so streams and batches cannot drift apart. Within a
trigger rows are put in order; a row that is older than the last one of its series cannot be applied any
more and is dropped and counted in the state (``late`` of the emitted rows).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..model import Series, need
from ..operators.bars import TIMEFRAMES, _summary
from ..operators.scan import Emitter, Kernel


def time_bars(stream: DataFrame, s: Series, timeframe: str, watermark: str = "10 minutes", price: str = "price", volume: str = "volume") -> DataFrame:
    """Bars are given out once the watermark has passed them (append); later ticks are dropped."""
    ts = s.order[0]
    made = stream.withWatermark(ts, watermark).groupBy(F.window(ts, TIMEFRAMES[timeframe]).alias("_w"), *s.keys).agg(*_summary(s, price, volume))
    return made.select(*s.keys, F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume")


def sliding_vwap(stream: DataFrame, s: Series, size: str, slide: str, watermark: str = "10 minutes", price: str = "price", volume: str = "volume") -> DataFrame:
    ts = s.order[0]
    window = F.window(ts, size, slide)
    made = stream.withWatermark(ts, watermark).groupBy(window.alias("_w"), *s.keys).agg(F.sum(F.col(price) * F.col(volume)).alias("_pv"), F.sum(F.col(volume).cast("double")).alias("_v"))
    return made.select(*s.keys, F.col("_w.start").alias("ts"), F.try_divide("_pv", "_v").alias("vwap"))


def session_vwap(stream: DataFrame, s: Series, gap: str, watermark: str = "10 minutes", price: str = "price", volume: str = "volume") -> DataFrame:
    """Anchored at the first tick after a silence of ``gap``."""
    ts = s.order[0]
    made = stream.withWatermark(ts, watermark).groupBy(F.session_window(ts, gap).alias("_w"), *s.keys).agg(F.sum(F.col(price) * F.col(volume)).alias("_pv"), F.sum(F.col(volume).cast("double")).alias("_v"))
    return made.select(*s.keys, F.col("_w.start").alias("ts"), F.try_divide("_pv", "_v").alias("vwap"))


def last_rows(stream: DataFrame, s: Series, n: int, redraw: Callable[[tuple, pd.DataFrame], None], every: int = 1, checkpoint: str | None = None):
    """Start a query that keeps the last n rows of each series and hands them to ``redraw(key, rows)`` in the driver whenever ``every`` rows
    have come since it last did. The buffer is bounded by n rows a series that is followed: a feed of some symbols, not of all."""
    order, keys = list(s.order), list(s.keys)
    need(stream, *keys, *order)
    held: dict[tuple, pd.DataFrame] = {}
    come: dict[tuple, int] = {}

    def follow(batch: DataFrame, number: int) -> None:
        back = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
        counts = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("_come"))
        newest = batch.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= n).drop("_back").toPandas()
        for row in counts.toLocalIterator():
            key = tuple(row[k] for k in keys)
            mine = newest
            for k, v in zip(keys, key):
                mine = mine[mine[k] == v] if v is not None else mine[mine[k].isna()]
            held[key] = pd.concat([held[key], mine] if key in held else [mine]).sort_values(order).tail(n)
            come[key] = come.get(key, 0) + row["_come"]
            if come[key] >= every:
                come[key] = 0
                redraw(key, held[key].reset_index(drop=True))

    query = stream.writeStream.foreachBatch(follow)
    return (query.option("checkpointLocation", checkpoint) if checkpoint else query).start()


def _stateful(stream: DataFrame, s: Series, inputs: Sequence[str], shape: str, start: Callable, step: Callable, forget: str | None = None) -> DataFrame:
    order = list(s.order)
    columns = list(dict.fromkeys([*s.keys, *order, *inputs]))
    need(stream, *columns)
    silent = None if forget is None else int(pd.Timedelta(forget).total_seconds() * 1000)
    timeout = GroupStateTimeout.NoTimeout if silent is None else GroupStateTimeout.ProcessingTimeTimeout

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        if silent is not None:
            state.setTimeoutDuration(silent)
        held, last, late = pickle.loads(state.get[0]) if state.exists else (start(), None, 0)
        rows = pd.concat(list(parts)).sort_values(order)
        marks = list(map(tuple, rows[order].to_numpy()))
        # rows equal in order to the last one belong with it if they come in the same trigger, and cannot be told from it after
        fresh = np.array([last is None or m > last for m in marks], bool)
        late += int((~fresh).sum())
        rows = rows[fresh]
        if len(rows):
            last = tuple(rows[order].to_numpy()[-1])
            x = {c: rows[c].astype("datetime64[us]").astype("int64").to_numpy() if c == order[0] else rows[c].to_numpy(dtype=float) for c in inputs}
            made, held = step(held, x, rows)
            state.update((pickle.dumps((held, last, late)),))
            if len(made):
                yield pd.concat([pd.DataFrame([key] * len(made), columns=list(s.keys)), made.reset_index(drop=True).assign(late=late)], axis=1)
        else:
            state.update((pickle.dumps((held, last, late)),))

    fields = ", ".join(f"{k} {stream.schema[k].dataType.simpleString()}" for k in s.keys)
    return stream.select(*columns).groupBy(*s.keys).applyInPandasWithState(run, f"{fields}, {shape}, late long", "state binary", "append", timeout)


def indicators(stream: DataFrame, s: Series, inputs: Sequence[str], kernels: Sequence[Kernel], forget: str | None = None) -> DataFrame:
    """keys, the order columns and the kernels' outputs for every row of the stream: recurrences, and windows of n rows (``kernels.Windowed``).

    ``forget``: how long a series may be silent before its state goes, such as "6 hours"; it then begins anew.
    """
    kinds = [f"{c} {stream.schema[c].dataType.simpleString()}" for c in s.order]

    def step(states: list, x: dict, rows: pd.DataFrame) -> tuple[pd.DataFrame, list]:
        out, after = rows[list(s.order)].copy(), []
        for kernel, state in zip(kernels, states):
            made, state = kernel.run(state, x)
            after.append(state)
            for c in kernel.outputs:
                out[c] = made[c]
        return out, after

    shape = ", ".join([*kinds, *[f"{c} double" for k in kernels for c in k.outputs]])
    return _stateful(stream, s, inputs, shape, lambda: [k.start() for k in kernels], step, forget)


def bars(stream: DataFrame, s: Series, inputs: Sequence[str], emitter: Emitter, forget: str | None = None) -> DataFrame:
    """keys and the emitter's fields for every bar that the stream completes; a bar in the making stays in the state."""
    names = [n for n, _ in emitter.fields]

    def step(state, x: dict, rows: pd.DataFrame) -> tuple[pd.DataFrame, object]:
        made, state = emitter.run(state, x)
        return pd.DataFrame(made, columns=names), state

    return _stateful(stream, s, inputs, ", ".join(f"{n} {k}" for n, k in emitter.fields), emitter.start, step, forget)
