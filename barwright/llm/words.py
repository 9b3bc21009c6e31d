"""Words of many texts at once, from the bytes of an Arrow column and without a Python object for each word.

A word is what stands between ASCII white space. Its hash comes from a running sum of bytes times powers of an
odd base modulo 2^64, so all words of a portion of texts are found and hashed by a few array operations.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
PORTION = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


_HELD: dict = {}
#: Arrays of this many bytes are mapped on their own; of freed memory at the heap's end, this much may stay.
MAPPED, SPARE = 1 << 20, 8 << 20


def _returned() -> None:
    """Memory that was freed goes back to the system, and large arrays do as soon as they are freed. A worker process lives on from one
    operator to the next, and the C library by itself would keep for it the most that any of them had. Other C libraries are left as they are."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, MAPPED)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, SPARE)  # M_TRIM_THRESHOLD
        libc.malloc_trim(0)
    except (OSError, TypeError, AttributeError):
        pass


def of_process(name: tuple, make: Callable[[], Any]) -> Any:
    """What this process remembers under a name, made when first asked for. One thing is held at a time: who comes next drops what an operator before it held."""
    if name not in _HELD:
        _HELD.clear()
        _returned()
        _HELD[name] = make()
    return _HELD[name]


class Powers:
    """Powers of the base and of its inverse, as many as were asked for."""

    def __init__(self):
        self.held = [np.ones(1, "u8"), np.ones(1, "u8")]

    def upto(self, n: int) -> list[np.ndarray]:
        if len(self.held[0]) < n:
            size = 1 << n.bit_length()
            self.held = [np.multiply.accumulate(np.append(np.uint64(1), np.full(size, b, "u8"))) for b in (BASE, pow(BASE, -1, 1 << 64))]
        return [h[:n] for h in self.held]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stretch_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """A hash, never 0, of values[start:end] for each pair."""
    up, down = powers.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, "u8")
    np.multiply(values, up[: len(values)], out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype("u8")) | np.uint64(1)


@dataclass
class Portion:
    """first: row of the first text. counts: words by text. starts, ends: bytes of each word in ``data``. hashes: of each word."""

    first: int
    data: np.ndarray
    counts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray

    def words_at(self, at: np.ndarray) -> list[str]:
        data = self.data.tobytes()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist())]

    def spaced(self, gap: int) -> tuple[np.ndarray, np.ndarray]:
        """The hashes with ``gap`` zeros after each text, and where each text begins."""
        begins = np.cumsum(self.counts + gap) - self.counts - gap
        out = np.zeros(len(self.hashes) + gap * len(self.counts), "u8")
        out[np.arange(len(self.hashes)) + gap * np.repeat(np.arange(len(self.counts)), self.counts)] = self.hashes
        return out, begins


def cuts(texts: pa.Array, most: int = PORTION) -> Iterator[tuple[int, int]]:
    """First row and number of rows of parts of about ``most`` bytes, a longer text in one of its own."""
    kind = "<i8" if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else "<i4"
    offsets = np.frombuffer(texts.buffers()[1] or bytes(8), kind)[texts.offset : texts.offset + len(texts) + 1]
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last - first
        first = last


def sliced(batch: pa.RecordBatch, most: int = PORTION) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most`` bytes of ``text``, so that what is made of a slice stays small."""
    for first, count in cuts(batch.column("text"), most):
        yield batch.slice(first, count)


def spans(texts: pa.Array, prepare: Callable[[pa.Array], pa.Array] | None = None, most: int = PORTION, swap: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """A column of strings in portions of about ``most`` bytes, each made ready by ``prepare``, and its bytes by ``swap`` (256 values): row
    of the first text, all bytes, where texts begin and end in them, and starts and ends of words. Null is empty."""
    for first, count in cuts(texts, most):
        held = texts.slice(first, count)
        held = (prepare(held) if prepare else held).cast(pa.large_binary()).fill_null(b"")
        bounds = np.frombuffer(held.buffers()[1], "<i8")[held.offset : held.offset + count + 1]
        part, bounds = np.frombuffer(held.buffers()[2] or b"", "u1")[bounds[0] : bounds[-1]], bounds - bounds[0]
        part = part if swap is None else swap[part]
        solid = ~SPACE[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[bounds] = True  # a word never goes from one text to the next
        starts = np.flatnonzero(solid & (edge[:-1] | ~np.append(False, solid[:-1])))
        ends = np.flatnonzero(solid & (edge[1:] | ~np.append(solid[1:], False))) + 1
        yield first, part, bounds, starts, ends


def portions(texts: pa.Array, powers: Powers, prepare: Callable[[pa.Array], pa.Array] | None = None, most: int = PORTION) -> Iterator[Portion]:
    """The words of a column of strings, in portions as in ``spans``."""
    for first, part, bounds, starts, ends in spans(texts, prepare, most):
        counts = np.diff(np.searchsorted(starts, bounds))
        yield Portion(first, part, counts, starts, ends, stretch_hashes(part, starts, ends, powers))
