"""Groups of rows dealt out in blocks of bounded size, each pair of blocks to one task.

A group of at most ``limit`` rows is one block. A larger one is cut in k blocks by a hash, and each
row is sent to the k pairs that its block is part of; rows of every pair of blocks meet exactly once.
So no task holds more than two blocks, however large a group becomes, and no pair of rows is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Places of a bit map, as powers of two (16 MB at most).
LEAST_BITS, MOST_BITS = 20, 27


def deal(rows: DataFrame, key: str, member: str, limit: int) -> DataFrame:
    """Adds ``lo``, ``hi`` (the pair of blocks) and ``own`` (the row's block), dealt out and sorted by (key, lo, hi)."""
    heavy = rows.groupBy(key).count().where(F.col("count") > limit).select(key, F.ceil(F.col("count") / limit).cast("int").alias("_k"))
    own = F.pmod(F.xxhash64(member), F.col("_k")).cast("int")
    marked = rows.join(heavy, key, "left").withColumn("_k", F.coalesce("_k", F.lit(1))).withColumn("own", own)
    each = marked.withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    paired = each.select("*", F.least("own", "_q").alias("lo"), F.greatest("own", "_q").alias("hi")).drop("_q", "_k")
    return paired.repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi")


def groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """Consecutive rows with equal ``by``, from sorted batches; groups of one row are passed over."""
    held: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = now if held is None else pa.concat_tables([held, now])
        if not now.num_rows:
            continue
        change = np.zeros(now.num_rows, bool)
        for name in by:
            values = now.column(name).to_numpy()
            change[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(change)
        ends = np.append(starts, now.num_rows)
        starts = np.append(0, starts)
        last = starts[-1]
        for a, b in zip(starts[:-1], ends[:-1]):
            if b - a > 1:
                yield now.slice(a, b - a)
        held = now.slice(last)
    if held is not None and held.num_rows > 1:
        yield held


def chunks(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.Table]:
    """Rows sorted by a column, cut between batches where its value changes."""
    held: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = now if held is None else pa.concat_tables([held, now])
        if not now.num_rows:
            continue
        values = now.column(by).to_numpy()
        last = int(np.flatnonzero(np.append(True, values[1:] != values[:-1]))[-1])
        if last:
            yield now.slice(0, last)
        held = now.slice(last)
    if held is not None and held.num_rows:
        yield held


class BitMap:
    """Which of 2^bits places, by the last bits of a hash, are taken. From (word of 64 places, bits of it)."""

    def __init__(self, bits: int, at: np.ndarray, words: np.ndarray):
        self.mask = np.uint64((1 << bits) - 1)
        self.words = np.zeros(max(1, (1 << bits) >> 6), "u8")
        self.words[at] = words.view("u8")

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes & self.mask
        return (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def bit_map(held: DataFrame, column: str) -> BitMap:
    """The map of a column of hashes, 16 places for each row up to 2^MOST_BITS in all; the driver takes in a 64th of that in rows at most.
    A map tells what is certainly not there. In one that is too small for its rows more seems to be there than is."""
    bits = int(np.clip(int(16 * held.count()).bit_length(), LEAST_BITS, MOST_BITS))
    place = F.col(column).bitwiseAND((1 << bits) - 1)
    one = F.expr("shiftleft(1L, cast(place & 63 as int))")
    words = held.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(one).alias("word")).toPandas()
    return BitMap(bits, words["at"].to_numpy().astype("i8"), words["word"].to_numpy().astype("i8"))


class Forest:
    """Merges labels of n rows and keeps the links that were needed: a spanning forest, not all pairs."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.kept: list[tuple[int, int]] = []

    def link(self, row: int, others: np.ndarray) -> None:
        labels, first = np.unique(self.label[others], return_index=True)
        fresh = labels != self.label[row]
        if not fresh.any():
            return
        self.kept += [(row, int(x)) for x in others[first[fresh]]]
        merged = np.append(labels[fresh], self.label[row])
        self.label[np.isin(self.label, merged)] = merged.min()
