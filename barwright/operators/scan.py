"""Recurrences over ordered series, in bounded memory.

A kernel takes a piece of a series as arrays and the state that the piece before left, and gives its
outputs and the new state. Rows come range by range as Arrow batches, sorted by series and order, so a
task holds one batch and one state however long a series is. The same kernels serve streams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..model import Series, need

Arrays = dict[str, np.ndarray]


class Kernel(Protocol):
    """outputs: names of the double columns that are made."""

    outputs: tuple[str, ...]

    def start(self) -> Any: ...

    def run(self, state: Any, x: Arrays) -> tuple[Arrays, Any]: ...


class Emitter(Protocol):
    """Like a kernel, but gives any number of rows for a piece, and what is left at the series' end."""

    fields: tuple[tuple[str, str], ...]

    def start(self) -> Any: ...

    def run(self, state: Any, x: Arrays) -> tuple[list[tuple], Any]: ...

    def finish(self, state: Any) -> list[tuple]: ...


def _changes(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Where a new series begins within the batch."""
    change = np.zeros(batch.num_rows, bool)
    for k in keys:
        codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    return np.append(0, np.flatnonzero(change))


def _pieces(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[bool, tuple, pa.RecordBatch]]:
    """(whether a series begins, its keys, rows of it)."""
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _changes(batch, keys)
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            part = batch.slice(int(a), int(b - a))
            key = tuple(part.column(k)[0].as_py() for k in keys)
            yield last != key, key, part
            last = key


def _array(column: pa.Array) -> np.ndarray:
    if pa.types.is_timestamp(column.type):
        return column.cast(pa.int64()).to_numpy(zero_copy_only=False)
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)


def _runner(keys: Sequence[str], inputs: Sequence[str], kernels: Sequence[Kernel]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: list = []
        for fresh, _, part in _pieces(batches, keys):
            if fresh:
                states = [k.start() for k in kernels]
            x = {c: _array(part.column(c)) for c in inputs}
            columns, names = list(part.columns), list(part.schema.names)
            for n, kernel in enumerate(kernels):
                made, states[n] = kernel.run(states[n], x)
                for c in kernel.outputs:
                    columns.append(pa.array(made[c], pa.float64(), from_pandas=True))
                    names.append(c)
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def scan(df: DataFrame, s: Series, inputs: Sequence[str], kernels: Sequence[Kernel], arranged: bool = False) -> DataFrame:
    """``df`` with the outputs of all kernels, in one pass. ``arranged``: the rows lie as ``Series.arrange`` puts them."""
    need(df, *s.keys, *s.order, *inputs)
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for k in kernels for c in k.outputs]])
    placed = df if arranged else s.arrange(df)
    return placed.mapInArrow(_runner(s.keys, tuple(inputs), tuple(kernels)), schema)


def _emitter(keys: Sequence[str], inputs: Sequence[str], emitter: Emitter, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, at = None, None

        def rows(key: tuple, made: list[tuple]) -> Iterator[pa.RecordBatch]:
            if made:
                columns = [[v] * len(made) for v in key] + [list(c) for c in zip(*made)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for fresh, key, part in _pieces(batches, keys):
            if fresh:
                if at is not None:
                    yield from rows(at, emitter.finish(state))
                state, at = emitter.start(), key
            made, state = emitter.run(state, {c: _array(part.column(c)) for c in inputs})
            yield from rows(key, made)
        if at is not None:
            yield from rows(at, emitter.finish(state))

    return run


def emit(df: DataFrame, s: Series, inputs: Sequence[str], emitter: Emitter, arranged: bool = False) -> DataFrame:
    """keys and the emitter's fields. Timestamps go in and out as microseconds and come back as timestamps."""
    from pyspark.sql.pandas.types import to_arrow_schema

    need(df, *s.keys, *s.order, *inputs)
    schema = T.StructType([df.schema[k] for k in s.keys] + [T.StructField(n, T._parse_datatype_string(kind)) for n, kind in emitter.fields])
    placed = (df if arranged else s.arrange(df)).select(*dict.fromkeys([*s.keys, *inputs]))
    return placed.mapInArrow(_emitter(s.keys, tuple(inputs), emitter, to_arrow_schema(schema)), schema)


Factory = Callable[[], Kernel]
