"""Embedding near-duplicates by a forest of random-projection trees.

Vectors are unit-scaled in double precision and equal ones of a label become one node. Trees are fitted
on a bounded sample (``SAMPLE`` vectors, chosen by a hash): each inner node splits at the median of a random projection,
and a vector near the split goes to both sides: within ``SPILL`` times what the projections of two vectors of cosine
``LEAST`` differ by (their standard deviation), so that spill does not depend on the vectors' length. All vectors are routed
through every tree. Leaves of over ``BIG`` vectors, as a sample leaves them in large tables, are split on in the
same way by medians over all their vectors, level by level. Those that share label, tree and leaf are compared in blocks by matrix products, so a link is
found exactly once: in the first tree, and the first leaf of it, that both ends share. Each task returns link
counts by vector and a spanning forest of its links; components are joined by stars.

A null label, and a vector that is null, empty, zero, or holds null or non-finite components, links with
nothing; vectors of different lengths do not link; a null vec_id is carried and never a component's id;
repeated rows are separate vectors that link with each other; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Forest, deal, groups
from .common import Staged
from .components import connected_components

LEAST, TREES, LEAF, SPILL, SAMPLE, SEED, BLOCK, BIG = 0.98, 4, 512, 0.6, 20_000, 7, 2048, 8192
#: Of the sample, whatever the vectors' length.
SAMPLE_BYTES = 16 << 20


class Tree:
    """Inner nodes as (direction, threshold, left, right); a leaf is a negative number."""

    def __init__(self, sample: np.ndarray, leaf: int, seed: int, spill: float):
        random = np.random.default_rng(seed)
        self.nodes: list[tuple] = []
        self.spill, self.leaves = spill, 0
        self.root = self._grow(sample, leaf, random)

    def _grow(self, rows: np.ndarray, leaf: int, random: np.random.Generator) -> int:
        if len(rows) <= leaf:
            self.leaves += 1
            return -self.leaves
        direction = random.standard_normal(rows.shape[1])
        direction /= np.linalg.norm(direction)
        at = rows @ direction
        split = float(np.median(at))
        left, right = rows[at < split], rows[at >= split]
        if not len(left) or not len(right):  # a heap of like vectors cannot be split
            self.leaves += 1
            return -self.leaves
        me = len(self.nodes)
        self.nodes.append(())
        self.nodes[me] = (direction, split, self._grow(left, leaf, random), self._grow(right, leaf, random))
        return me

    def route(self, rows: np.ndarray) -> list[list[int]]:
        """The leaves of each row, in ascending order."""
        out: list[list[int]] = [[] for _ in rows]
        todo = [(self.root, np.arange(len(rows)))]
        while todo:
            node, mine = todo.pop()
            if node < 0:
                for i in mine.tolist():
                    out[i].append(-node)
                continue
            direction, split, left, right = self.nodes[node]
            at = rows[mine] @ direction
            todo.append((left, mine[at < split + self.spill]))
            todo.append((right, mine[at >= split - self.spill]))
        return [sorted(x) for x in out]


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, size)


def _scaled(v: list | None) -> bytes | None:
    """The unit vector's bytes, None where the vector cannot be compared."""
    if not v or None in v:
        return None
    x = np.array(v, np.float64)
    top = np.abs(x).max()
    if not np.isfinite(x).all() or top == 0:
        return None
    x = x / top
    return (x / np.sqrt(x @ x) + 0.0).astype("<f8").tobytes()


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [_scaled(v) for v in batch.column("embedding").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(made, pa.binary()), pa.array([None if m is None else len(m) // 8 for m in made], pa.int32())], ["vec_id", "label", "unit", "size"])


def spill_of(spill: float, least: float, size: int) -> float:
    """How far from a split a vector goes to both sides: two unit vectors of that cosine are sqrt(2 - 2 cos) apart, in ``size`` directions."""
    return spill * float(np.sqrt(max(2 - 2 * least, 0.0) / size))


def _projector(seed: int):
    """Adds the projection on a direction that the leaf's number draws."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, leaf, sizes = np.zeros(batch.num_rows), batch.column("leaf").to_numpy(), batch.column("size").to_numpy()
            for size, name in set(zip(sizes.tolist(), leaf.tolist())):
                mine = np.flatnonzero((leaf == name) & (sizes == size))
                direction = np.random.default_rng([seed, name & 0xFFFFFFFFFFFFFFFF]).standard_normal(size)
                out[mine] = _matrix(batch.column("unit").take(pa.array(mine)), size) @ (direction / np.linalg.norm(direction))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "at"])

    return project


def _grown(routed: DataFrame, least: float, spill: float, big: int, seed: int) -> DataFrame:
    """Splits leaves of over ``big`` vectors until none is left that splits, and gathers anew the leaves of each vector."""
    by = ["label", "size", "leaf"]
    held = Staged(routed.drop("codes"), "embed-routed")
    done: list[DataFrame] = []
    while True:
        rows = held.read()
        full = rows.groupBy(*by).count().where(F.col("count") > big).select(*by)
        if full.isEmpty():
            break
        kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        placed = Staged(rows.join(full, by, "left_semi").select(rows.columns).mapInArrow(_projector(seed), f"{kind}, at double"), "embed-projected")
        split = placed.read().groupBy(*by).agg(F.percentile_approx("at", F.lit(0.5)).alias("split"), F.min("at").alias("low"), F.max("at").alias("high"))
        near = F.lit(spill) * F.sqrt(F.lit(max(2 - 2 * least, 0.0)) / F.col("size"))
        sides = F.array_compact(F.array(F.when(F.col("at") < F.col("split") + near, F.lit(0)), F.when(F.col("at") >= F.col("split") - near, F.lit(1))))
        # a heap of like vectors does not split: it is compared by blocks
        parts = (F.col("low") < F.col("split") - near) | (F.col("high") >= F.col("split") + near)
        told = placed.read().join(split, by).withColumn("parts", parts)
        done += [rows.join(full, by, "left_anti"), told.where(~F.col("parts")).select(rows.columns)]
        after = told.where("parts").withColumn("side", F.explode(sides)).withColumn("leaf", F.xxhash64("leaf", "side")).select(rows.columns)
        held = Staged(after, "embed-routed")
    whole = held.read()
    for part in done:
        whole = whole.unionByName(part)
    codes = whole.groupBy("node").agg(F.array_sort(F.collect_list("leaf")).alias("codes"))
    return whole.join(codes, "node")


def _router(forests: dict[int, list[Tree]]):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                mine = batch.filter(pa.array(sizes == size))
                rows = _matrix(mine.column("unit"), int(size))
                routed = [t.route(rows) for t in forests.get(int(size), [Tree(rows[:0], LEAF, 0, 0.0)])]
                at, tree, leaf, codes = [], [], [], []
                for i in range(len(rows)):
                    code = [n << 32 | x for n, r in enumerate(routed) for x in r[i]]
                    for c in code:
                        at.append(i)
                        leaf.append(c)
                        codes.append(code)
                picked = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([mine.column("node").take(picked), mine.column("label").take(picked), mine.column("size").take(picked), mine.column("n").take(picked), mine.column("unit").take(picked), pa.array(leaf, pa.int64()), pa.array(codes, pa.list_(pa.int64()))], ["node", "label", "size", "n", "unit", "leaf", "codes"])

    return route


def _comparer(least: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ("key", "lo", "hi")):
            size, leaf = group.column("size")[0].as_py(), group.column("leaf")[0].as_py()
            lo, hi, own = group.column("lo")[0].as_py(), group.column("hi")[0].as_py(), group.column("own").to_numpy()
            rows, node, times = _matrix(group.column("unit"), size), group.column("node").to_numpy(), group.column("n").to_numpy()
            shared = [set(c[: c.index(leaf)]) for c in group.column("codes").to_pylist()]
            left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
            if not left.size or not right.size:
                continue
            forest, counts = Forest(len(rows)), np.zeros(len(rows), np.int64)
            for a in range(0, len(left), 256):
                part = left[a : a + 256]
                close = rows[part] @ rows[right].T >= least
                for i, line in zip(part.tolist(), close):
                    near = right[line]
                    near = near[near > i] if lo == hi else near
                    if shared[i]:
                        near = near[[shared[i].isdisjoint(shared[j]) for j in near.tolist()]] if near.size else near
                    if near.size:
                        counts[i] += times[near].sum()
                        counts[near] += times[i]
                        forest.link(i, near)
            found = np.flatnonzero(counts)
            if found.size:
                ends = np.array(forest.kept, np.int64).reshape(-1, 2)
                a = np.concatenate([node[found], node[ends[:, 0]]])
                b = np.concatenate([node[found], node[ends[:, 1]]])
                n = np.concatenate([counts[found], np.zeros(len(ends), np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "n"])

    return compare


def _fit(nodes: DataFrame, least: float, trees: int, leaf: int, spill: float, sample: int, seed: int) -> dict[int, list[Tree]]:
    """By vector length, trees over a sample of at most about ``sample`` vectors; leaves hold ``leaf`` of all vectors in expectation, but at least 8 of the sample."""
    # vectors of a length of which there are few are one leaf
    counts = {r["size"]: r["count"] for r in nodes.groupBy("size").count().where(F.col("count") > leaf).collect()}
    out = {}
    for size, count in counts.items():
        most = min(sample, SAMPLE_BYTES // (8 * size))
        share = min(1.0, most / count)
        chosen = nodes.where((F.col("size") == size) & (F.pmod(F.xxhash64(F.lit("forest"), "unit"), F.lit(1 << 30)) < int(share * (1 << 30))))
        rows = [bytes(r[0]) for r in chosen.select("unit").limit(2 * most).collect()]
        held = _matrix(pa.array(sorted(rows), pa.binary()), size)
        out[size] = [Tree(held, max(8, int(leaf * share)), seed + n, spill_of(spill, least, size)) for n in range(trees)]
    return out


def links(vectors: DataFrame, least: float = LEAST, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, sample: int = SAMPLE, seed: int = SEED, big: int = BIG) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    scaled = vectors.select("vec_id", "label", "embedding").mapInArrow(_unit, f"vec_id {kinds['vec_id']}, label {kinds['label']}, unit binary, size int")
    comparable = F.col("label").isNotNull() & F.col("unit").isNotNull()
    units = Staged(scaled.withColumn("node", F.when(comparable, F.xxhash64("label", "unit"))), "embed-units").read()
    distinct = Staged(units.where("node is not null").groupBy("node", "label", "size", "unit").agg(F.count("*").alias("n"), F.min("vec_id").alias("first")), "embed-nodes")
    nodes = distinct.read()
    forests = _fit(nodes, least, trees, leaf, spill, sample, seed)
    routed = nodes.select("node", "label", "size", "n", "unit").mapInArrow(_router(forests), f"node long, label {kinds['label']}, size int, n long, unit binary, leaf long, codes array<long>")
    leaves = Staged(routed, "embed-leaves")
    routed = leaves.read()
    if not routed.groupBy("label", "size", "leaf").count().where(F.col("count") > big).isEmpty():
        routed = _grown(routed, least, spill, big, seed)
    dealt = deal(routed.withColumn("key", F.xxhash64("label", "size", "leaf")), "key", "node", BLOCK)
    compared = Staged(dealt.mapInArrow(_comparer(least), "a long, b long, n long"), "embed-links")
    leaves.drop()
    found = compared.read()
    others = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    place = connected_components(found.select("a", "b"))
    whole = nodes.select("node", "n", "first").join(others, "node", "left").join(place, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_id = whole.groupBy("component").agg(F.min("first").alias("component_id"))
    # only nodes with copies or links need a row; the rest are their own component
    busy = whole.where("n > 1 or others is not null").join(least_id, "component").select("node", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    busy = Staged(busy, "embed-busy").read()
    for table in (distinct, compared):
        table.drop()
    return units.select("vec_id", "node").join(busy, "node", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def links_sql(least: float = LEAST) -> str:
    return f"""WITH RECURSIVE v AS (SELECT row_number() OVER () AS rk, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.rk AS a, b.rk AS b FROM u a JOIN u b ON a.label = b.label AND a.rk != b.rk AND len(a.e) = len(b.e)
    AND list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= {least}),
r AS (SELECT rk AS a, rk AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT r.a AS rk, min(v.vec_id) AS component_id FROM r JOIN v ON v.rk = r.b GROUP BY r.a),
n AS (SELECT a AS rk, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM v JOIN c USING (rk) LEFT JOIN n USING (rk)"""
