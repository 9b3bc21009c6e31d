"""SimHash near-duplicates, linked through BK-trees.

Fingerprints of whole texts come from Arrow batches; equal fingerprints are one node from there on.
Two fingerprints within two bits agree in at least two of four 16-bit blocks, so each fingerprint is
dealt to six shards, by the bits of each pair of blocks. In each shard (cut in blocks when large) a
BK-tree is built, whose children are keyed by their Hamming distance to the parent, and the shard's
fingerprints follow only the edges within the radius. Each task returns a spanning forest of the
links it found; components are joined by stars (see ``components``).

Null and empty texts have fingerprint zero and are linked like any other; a null doc_id is carried and
never becomes a component's id unless all ids of the component are null; repeated rows each give a
result row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import near
from .blocks import Forest, deal, groups
from .common import Staged
from .components import connected_components
from .words import sliced

SEED, RADIUS, BLOCK = 42, 2, 4096
PAIRS = ((0, 16), (0, 32), (0, 48), (16, 32), (16, 48), (32, 48))


def fingerprint(raw: bytes | None, width: int = 3) -> int:
    """64 bits: set where over half of the shingles' hashes have theirs set. The bytes are UTF-8."""
    words = (raw or b"").lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0] + [e + 1 for e in ends[:-1]]
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chain.from_iterable(map(sliced, batches)):
        texts = batch.column("text").cast(pa.binary())
        found = np.fromiter((fingerprint(t.as_py()) for t in texts), "u8", batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view("i8"))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, f"doc_id {kind}, fp long")


class BKTree:
    """Over distinct 64-bit values. A node is (row, [(distance, child)]); queries walk down in batches."""

    def __init__(self, values: np.ndarray):
        self.values, self.nodes = values, []
        todo = [(np.arange(len(values)), -1, 0)] if len(values) else []
        while todo:
            rows, parent, distance = todo.pop()
            me, root, rest = len(self.nodes), rows[0], rows[1:]
            self.nodes.append((root, []))
            if parent >= 0:
                self.nodes[parent][1].append((distance, me))
            if rest.size:
                far = np.bitwise_count(values[rest] ^ values[root])
                order = np.argsort(far, kind="stable")
                rest, far = rest[order], far[order]
                for part in np.split(np.arange(rest.size), np.flatnonzero(np.diff(far)) + 1):
                    todo.append((rest[part], me, int(far[part[0]])))

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(row of the tree, rows of ``queries`` within the radius of it), for each row that has any."""
        todo = [(0, np.arange(len(queries)))] if self.nodes and len(queries) else []
        while todo:
            node, asked = todo.pop()
            root, children = self.nodes[node]
            far = np.bitwise_count(queries[asked] ^ self.values[root]).astype(np.int16)
            if (near := asked[far <= radius]).size:
                yield root, near
            for distance, child in children:
                if (follow := asked[np.abs(far - distance) <= radius]).size:
                    todo.append((child, follow))


def _linker(radius: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ("key", "lo", "hi")):
            fps = group.column("fp").to_numpy().view("u8")
            own, lo, hi = group.column("own").to_numpy(), group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
            left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
            if not left.size or not right.size:
                continue
            forest = Forest(len(fps))
            for row, near in BKTree(fps[left]).within(fps[right], radius):
                forest.link(int(left[row]), right[near])
            if forest.kept:
                ends = np.array(forest.kept)
                yield pa.RecordBatch.from_arrays([pa.array(fps[ends[:, i]].view("i8")) for i in (0, 1)], ["a", "b"])

    return link


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct ``fp`` within ``radius`` (2 at most) bits."""
    if radius > 2:
        raise ValueError("shards of two blocks of four find pairs within two bits at most")
    part = lambda shift: F.shiftrightunsigned("fp", shift).bitwiseAND(0xFFFF)
    keys = [(F.shiftleft(part(a), 16).bitwiseOR(part(b)) + F.lit(n << 32)) for n, (a, b) in enumerate(PAIRS)]
    shards = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    return deal(shards, "key", "fp", block).mapInArrow(_linker(radius), "a long, b long")


def components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id (smallest doc_id that links reach)."""
    prints = Staged(fingerprints(docs), "simhash").read()
    distinct = Staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-first")
    firsts = distinct.read()
    found = connected_components(links(firsts.select("fp"), radius))
    linked = firsts.join(found.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    placed = linked.join(least, "component").select("fp", "component_id")
    whole = firsts.join(placed, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    placed_all = Staged(whole, "simhash-component").read()
    distinct.drop()
    return prints.join(placed_all, "fp", "left").select("doc_id", "fp", "component_id")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id."""
    return components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one of each component of near copies: that of the smallest doc_id. Rows without a doc_id stay.

    Near are five-word shingle sets of a Jaccard similarity of 0.8 or more. Fingerprints of them are linked by the trees of
    ``links`` and confirmed on the sets. Two bits hold few of the near copies beyond exact ones, so ``near`` completes
    the components by the shingles themselves.
    """
    best = near.components(docs, links).groupBy("component").agg(F.min(F.struct("doc_id", "print")).alias("best"))
    kept = best.select("best.doc_id", F.col("best.print").alias("_barwright_print"))
    named = docs.where("doc_id is not null").withColumn("_barwright_print", F.xxhash64("text"))
    again = Window.partitionBy("doc_id", "_barwright_print").orderBy(F.xxhash64(*docs.columns))
    chosen = named.join(kept, ["doc_id", "_barwright_print"], "left_semi").withColumn("_barwright_again", F.row_number().over(again))
    return chosen.where("_barwright_again = 1").select(docs.columns).unionByName(docs.where("doc_id is null"))
