"""Near copies by exact similarity of word shingles.

A text is the set of its five-word shingles (ASCII letters in lower case; a shorter text is one shingle).
Two texts are near copies if their sets have a Jaccard similarity of 0.8 or more; what is asked for is the
components of all such pairs. They are found in two rounds, both confirmed on whole sets:

1. Close copies. SimHash fingerprints of the sets are linked by the operator given (``close``), and of the sets
   that share a shingle of their prefix each is paired with two others of like size: the first and the one before in
   an order drawn from ``TURNS``. These are as many pairs as there are rows, however large a group of copies is.
2. The rest. If two sets are near, and all sets are put in one order, the first fifths (and one) of both share a
   shingle. So sets that meet under a shingle, are not yet of one component and may still reach the similarity by
   size and place are paired. Under the first shingle that two share nothing before it is common to both, so places
   count as if each were the first, and sets whose first ``HEADS`` shingles tell that they have met before make no pair
   again. No pair is missed, whatever the order; the order puts shingles that a sample shows to be common last, so
   that few sets meet in vain.

Before sets are sent to be confirmed, counts of their hashes in ranges bound what two can have in common: first in
``2 * SKETCH`` ranges, small enough to go with each row of a shingle, then in as many as half of the set has members.

Null and empty texts are equal to each other and near to no other; an empty table gives no components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BitMap, bit_map
from .common import Staged
from .components import connected_components
from .words import Powers, mix, of_process, portions, sliced

#: Similarity as a fraction.
WIDTH, NUMERATOR, DENOMINATOR = 5, 4, 5
#: Documents that tell common shingles, shingles remembered as common, sets in a block, parts of a common shingle.
SAMPLE, COMMON, BLOCK, PARTS = 8_000, 100_000, 2048, 64
#: Orders in which rows of a shingle take partners, bytes of a sketch, sets that a task remembers to have given out, shingles that tell of an earlier meeting.
TURNS, SKETCH, SEEN, HEADS = 8, 64, 500_000, 4
TURN = np.uint64(0x9E3779B97F4A7C15)
#: A row's part, size of its set and place in the order lie in one number, from these bits on.
PART_AT, SIZE_AT = 56, 28
LOW = (1 << SIZE_AT) - 1


def shingle_sets(texts: pa.Array, powers: Powers, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for portion in portions(texts, powers, pc.ascii_lower):
        words = portion.hashes
        joined = np.zeros(max(len(words) - width + 1, 0), "u8")
        for i in range(width):
            joined = mix(joined * TURN + words[i : i + len(joined)])
        at = 0
        for n in portion.counts.tolist():
            if n >= width:
                yield np.unique(joined[at : at + n - width + 1])
            elif n:
                whole = np.zeros(1, "u8")
                for i in range(at, at + n):
                    whole = mix(whole * TURN + words[i : i + 1])
                yield mix(whole + np.uint64(n))
            else:
                yield np.empty(0, "u8")
            at += n


def set_key(hashes: np.ndarray, powers: Powers) -> int:
    """One number for a set."""
    up = powers.upto(len(hashes) + 1)[0]
    return int(mix((mix(hashes) * up[: len(hashes)]).sum(dtype="u8", keepdims=True) + np.uint64(len(hashes))).view("i8")[0])


def majority(hashes: np.ndarray) -> int:
    """The SimHash of a set: bits that over half of its hashes have."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def sketch(hashes: np.ndarray) -> bytes:
    """How many hashes lie in each range, 15 for more, in four bits each."""
    counts = np.minimum(np.bincount((hashes >> np.uint64(57)).astype(np.int64), minlength=2 * SKETCH), 15).astype("u1")
    return (counts[:SKETCH] << 4 | counts[SKETCH:]).tobytes()


def sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "u1").reshape(-1, SKETCH)


def _reach(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m with these sketches may be near. Where both count 15 the range is not known."""
    high, low = np.minimum(a >> 4, b >> 4), np.minimum(a & 15, b & 15)
    bound = high.sum(axis=1, dtype=np.int64) + low.sum(axis=1, dtype=np.int64)
    return (bound * (NUMERATOR + DENOMINATOR) >= (n + m) * NUMERATOR) | (high == 15).any(axis=1) | (low == 15).any(axis=1)


def prefix_size(n: int) -> int:
    """A set of n that overlaps another by enough cannot keep all of these out of the overlap."""
    return n - -(-n * NUMERATOR // DENOMINATOR) + 1 if n else 0


class Common:
    """Shingles known to be common, sorted, how common each is, and from which count on a shingle is dealt out in parts."""

    def __init__(self, known: np.ndarray, rank: np.ndarray, many: float):
        self.known, self.rank, self.many = known, rank, many

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(hashes), "u8")
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.rank[at], np.uint64(0))

    def prefix(self, hashes: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray]:
        """The first shingles of a set, and the part of each, -1 for those that are not dealt out."""
        late = self.of(hashes)
        first = np.lexsort((hashes, late))[: prefix_size(len(hashes))]
        return hashes[first], np.where(late[first] > self.many, key % PARTS, -1).astype("i1")


def _prefixes(common: Common):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = of_process(("near",), Powers)
        seen: set[int] = set()
        for batch in chain.from_iterable(map(sliced, batches)):
            if len(seen) > SEEN:
                seen.clear()
            keys, fps, drawn, sizes, starts, ends, parts = [], [], [], [], [0], [np.empty(0, "u8")], [np.empty(0, "i1")]
            for hashes in shingle_sets(batch.column("text"), powers):
                keys.append(set_key(hashes, powers))
                fps.append(majority(hashes))
                drawn.append(sketch(hashes))
                sizes.append(len(hashes))
                shingles, part = common.prefix(hashes[:0] if keys[-1] in seen else hashes, keys[-1])
                seen.add(keys[-1])
                ends.append(shingles)
                parts.append(part)
                starts.append(starts[-1] + len(shingles))
            offsets = pa.array(starts, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in ([e.view("i8") for e in ends], parts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("print"), pa.array(keys, pa.int64()), pa.array(fps, pa.int64()), pa.array(drawn, pa.binary()), pa.array(sizes, pa.int32()), *lists], ["doc_id", "print", "key", "fp", "sketch", "n", "prefix", "part"])

    return cut


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = of_process(("near",), Powers)
    for batch in batches:
        for hashes in shingle_sets(batch.column("text"), powers):
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view("i8"))], ["shingle"])


def common_shingles(docs: DataFrame, block: int, sample: int = SAMPLE, most: int = COMMON) -> Common:
    """Shingles that two rows or more of a bounded sample have. They set the order and how work is dealt out, never which pairs are found."""
    share = min(1.0, sample / max(docs.count(), 1))
    chosen = docs.where(F.pmod(F.xxhash64(F.lit("near"), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")
    counts = chosen.mapInArrow(_shingles, "shingle long").groupBy("shingle").count().where("count > 1")
    top = counts.orderBy(F.desc("count"), "shingle").limit(most).toPandas()
    known, rank = top["shingle"].to_numpy().astype("i8").view("u8"), top["count"].to_numpy().astype("u8")
    order = np.argsort(known)
    return Common(known[order], rank[order], block * share)


def _lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that share a shingle with another, sorted by it, each set once and with two sets of like size: the first (``hub``) and the one before (``mate``). Nothing is held but one row."""
    names = ["token", "part", "band", "key", "size_at"]
    held: dict[str, np.ndarray] = {name: np.empty(0, "i8") for name in names}
    before, hub, mate = None, 0, 0

    def ready(now: dict[str, np.ndarray], last: bool) -> pa.RecordBatch:
        nonlocal before, hub, mate
        # copies of a set come one after the other; of the row held back only those after it are left out
        once = np.append(True, (now["token"][1:] != now["token"][:-1]) | (now["key"][1:] != now["key"][:-1]))
        now = {name: values[once] for name, values in now.items()}
        n = len(now["token"])
        fresh = np.ones(n, bool)
        for a, name in enumerate(names[:3]):
            fresh[1:] = (fresh[1:] if a else False) | (now[name][1:] != now[name][:-1])
            fresh[0] = (a > 0 and fresh[0]) or before is None or now[name][0] != before[a]
        start = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
        hubs = np.where(start >= 0, now["key"][start], hub)
        mates = np.where(fresh, now["key"], np.append(mate, now["key"][:-1]))
        meets = now["token"][1:] == now["token"][:-1]
        first = before is not None and before[0] == now["token"][0]
        kept = np.append(first, meets) | np.append(meets, False)
        count = n if last else n - 1  # the last row waits for the next
        out = {name: now[name][:count] for name in ("token", "part", "key", "size_at")} | {"hub": hubs[:count], "mate": mates[:count]}
        if count:
            before, hub, mate = tuple(now[name][count - 1] for name in names[:3]), hubs[count - 1], now["key"][count - 1]
        for name in names:
            held[name] = now[name][count:]
        return pa.RecordBatch.from_pydict(out).filter(pa.array(kept[:count]))

    for batch in batches:
        if batch.num_rows:
            now = {name: batch.column(name).to_numpy().astype("i8") for name in ("token", "key", "size_at")}
            now["part"], now["size_at"] = (now["size_at"] >> PART_AT) - 1, now["size_at"] & ((1 << PART_AT) - 1)
            now["band"] = np.log(np.maximum(now["size_at"] >> SIZE_AT, 1)) // np.log(DENOMINATOR / NUMERATOR)
            yield ready({name: np.concatenate((held[name], now[name].astype("i8"))) for name in names}, False)
    if len(held["token"]):
        yield ready(dict(held), True)


def _fits(n: np.ndarray, m: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether sets of n and m, whose first shingle in common is at p and q of the order, may have enough in common."""
    room = np.minimum(n - p, m - q)
    return (np.minimum(n, m) * DENOMINATOR >= np.maximum(n, m) * NUMERATOR) & (room * (NUMERATOR + DENOMINATOR) >= (n + m) * NUMERATOR)


def _met(own: np.ndarray, others: np.ndarray, at: int) -> np.ndarray:
    """Whether a set meets others, by the first shingles of each, under one that lies before ``at`` in the order."""
    return (others[:, :, None] == own[:at]).any(axis=(1, 2))


def _between(rows: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs of a left and a right row of different components that may be near."""
    n, p = rows["size_at"] >> SIZE_AT, rows["size_at"] & LOW
    for i in left.tolist():
        fine = right[(rows["place"][right] != rows["place"][i])]
        fine = fine[_fits(n[i], n[fine], p[i], p[fine])]
        fine = fine[~_met(rows["head"][i], rows["head"][fine], p[i])]
        fine = fine[_reach(rows["sketch"][i], rows["sketch"][fine], n[i], n[fine])]
        if fine.size:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fine), rows["key"][i])), pa.array(rows["key"][fine])], ["hub", "leaf"])


def _among(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Pairs of rows of one shingle. Those of the component that most belong to are not compared with each other."""
    places, inverse, counts = np.unique(rows["place"], return_inverse=True, return_counts=True)
    if len(places) < 2:
        return
    most = inverse == counts.argmax()
    few = np.flatnonzero(~most)
    yield from _between(rows, few, np.flatnonzero(most))
    for a in range(len(few)):
        yield from _between(rows, few[a : a + 1], few[a + 1 :])


def _cells(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[dict[str, np.ndarray]]:
    """Consecutive rows with equal ``by``, from sorted batches."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {name: batch.column(name).to_numpy() for name in batch.schema.names if name not in ("sketch", "head")}
        now |= {"sketch": sketches(batch.column("sketch")), "head": batch.column("head").flatten().to_numpy().reshape(-1, HEADS)}
        if held is not None:
            now = {name: np.concatenate((held[name], now[name])) for name in now}
        change = np.zeros(len(now[by[0]]), bool)
        for name in by:
            change[1:] |= now[name][1:] != now[name][:-1]
        bounds = np.append(0, np.flatnonzero(change))
        # whole groups that hold nothing to compare are passed over at once
        apart = np.add.reduceat(np.append(False, now["place"][1:] != now["place"][:-1]) & ~change, bounds) > 0
        for a, b in zip(bounds[:-1][apart[:-1]].tolist(), bounds[1:][apart[:-1]].tolist()):
            yield {name: values[a:b] for name, values in now.items()}
        held = {name: values[bounds[-1] :] for name, values in now.items()}
    if held is not None:
        yield held


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _cells(batches, ("token",)):
        yield from _among(rows)


def _large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _cells(batches, ("token", "lo", "hi")):
        lo, hi = rows["lo"][0], rows["hi"][0]
        if lo == hi:
            yield from _among(rows)
        else:
            yield from _between(rows, np.flatnonzero(rows["own"] == hi), np.flatnonzero(rows["own"] == lo))


def _dealt(heavy: DataFrame, block: int) -> DataFrame:
    """Rows of shingles with over ``block`` rows, in cells of two blocks. Rows of the component that most belong to
    (``own`` below 0) meet the others only, others meet each other too, each pair in one cell."""
    by_place = heavy.groupBy("token", "place").agg(F.count("*").alias("c"))
    main = by_place.groupBy("token").agg(F.max_by("place", F.struct("c", "place")).alias("main"), F.max("c").alias("m"), (F.sum("c") - F.max("c")).alias("s")).where("s > 0")
    k = lambda c: F.ceil(F.col(c) / block).cast("int")
    rows = heavy.join(main.select("token", "main", k("m").alias("k0"), k("s").alias("k1")), "token")
    most = F.col("place") == F.col("main")
    place = F.xxhash64("key")
    others = F.sequence(F.lit(0), F.col("k1") - 1)
    rows = rows.withColumn("own", F.when(most, -1 - F.pmod(place, F.col("k0"))).otherwise(F.pmod(place, F.col("k1"))).cast("int"))
    meets = F.when(most, others).otherwise(F.concat(F.transform(F.sequence(F.lit(1), F.col("k0")), lambda x: -x), others))
    cells = rows.withColumn("with", F.explode(meets)).withColumn("lo", F.least("own", "with")).withColumn("hi", F.greatest("own", "with"))
    return cells.select("token", "key", "size_at", "place", "sketch", "head", "own", "lo", "hi").repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi", "place")


def wide(hashes: np.ndarray) -> np.ndarray:
    """How many hashes lie in each of half as many ranges (128 at least), 255 for more."""
    bits = max(7, (len(hashes) - 1).bit_length() - 1)
    return np.minimum(np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype("u1")


def may_be_near(a: np.ndarray, b: np.ndarray) -> bool:
    """From counts in ranges: whether the sets may be near. A range that counts 255 is not known."""
    if (len(a) and a.max() == 255) or (len(b) and b.max() == 255):
        return True
    n, m = int(a.sum()), int(b.sum())
    a, b = a.astype("i4"), b.astype("i4")
    while len(a) != len(b):
        if len(a) > len(b):
            a = a.reshape(-1, 2).sum(axis=1)
        else:
            b = b.reshape(-1, 2).sum(axis=1)
    return int(np.minimum(a, b).sum()) * (NUMERATOR + DENOMINATOR) >= (n + m) * NUMERATOR


def are_near(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * DENOMINATOR >= (len(a) + len(b) - both) * NUMERATOR


def _brought(asked: BitMap, made: Callable[[np.ndarray], np.ndarray]):
    """What ``made`` makes of the sets of the rows whose print may be among those asked for."""

    def brought(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = of_process(("near",), Powers)
        for batch in chain.from_iterable(map(sliced, batches)):
            batch = batch.filter(pa.array(asked.has(batch.column("print").to_numpy().view("u8"))))
            if batch.num_rows:
                found = [made(s).tobytes() for s in shingle_sets(batch.column("text"), powers)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("print"), pa.array(found, pa.binary())], ["doc_id", "print", "held"])

    return brought


def _compared(kind: str, test: Callable[[np.ndarray, np.ndarray], bool]):
    """From rows sorted by (hub, cell), the hub's own first: the pairs that pass. One row is held."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in batches:
            fine = np.zeros(batch.num_rows, bool)
            hubs, leaves = batch.column("hub").to_pylist(), batch.column("leaf").to_pylist()
            for i, held in enumerate(batch.column("held")):
                if leaves[i] is None:
                    hub, own = hubs[i], np.frombuffer(held.as_py(), kind)
                elif hubs[i] == hub:
                    fine[i] = test(own, np.frombuffer(held.as_py(), kind))
            yield batch.select(["hub", "leaf"]).filter(pa.array(fine))

    return compare


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            fine = _reach(sketches(batch.column("x")), sketches(batch.column("y")), batch.column("n").to_numpy().astype("i8"), batch.column("m").to_numpy().astype("i8"))
            yield batch.select(["hub", "leaf"]).filter(pa.array(fine))


class Sets:
    """The distinct sets of a table's texts, made again from the texts of those asked for."""

    def __init__(self, docs: DataFrame, firsts: DataFrame, block: int):
        self.docs, self.firsts, self.block = docs, firsts, block
        self.used: list[Staged] = []

    def plausible(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (hub, leaf) that sizes and sketches leave possible."""
        x, y = (self.firsts.select(F.col("key").alias(end), F.col("sketch").alias(name), F.col("n").alias(size)) for end, name, size in (("hub", "x", "n"), ("leaf", "y", "m")))
        return pairs.join(x, "hub").join(y, "leaf").where(F.least("n", "m") * DENOMINATOR >= F.greatest("n", "m") * NUMERATOR).mapInArrow(_plausible, "hub long, leaf long")

    def near(self, pairs: Staged) -> DataFrame:
        """Links (a, b): those of the pairs (hub, leaf) whose sets are near."""
        possible = Staged(self._passing(pairs.read(), wide, "u1", may_be_near), "near-possible")
        self.used.append(possible)
        return self._passing(possible.read(), lambda s: s, "<u8", are_near).toDF("a", "b")

    def _passing(self, pairs: DataFrame, made: Callable[[np.ndarray], np.ndarray], kind: str, test: Callable[[np.ndarray, np.ndarray], bool]) -> DataFrame:
        """What is made of a leaf's set is sent once for each of its pairs, what is made of a hub's once for each block of leaves."""
        hubs = pairs.groupBy("hub").agg(F.ceil(F.count("*") / self.block).cast("int").alias("k"))
        own = hubs.select(F.col("hub"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("cell"), F.lit(None).cast("long").alias("leaf"), F.col("hub").alias("key"))
        cell = F.when(F.col("k") > 1, F.pmod(F.xxhash64("leaf"), F.col("k"))).otherwise(0).cast("int")
        leaves = pairs.join(hubs, "hub").select("hub", cell.alias("cell"), "leaf", F.col("leaf").alias("key"))
        sent = own.unionByName(leaves).join(self.firsts.select("key", "first.doc_id", "first.print"), "key").drop("key")
        # as a table its size is known, so that it is broadcast only if that is small
        sent = Staged(sent, "near-sent")
        self.used.append(sent)
        shape = f"doc_id {self.docs.schema['doc_id'].dataType.simpleString()}, print long, held binary"
        brought = self.docs.mapInArrow(_brought(bit_map(sent.read(), "print"), made), shape)
        # rows of one id and text have one set; its copies do no harm
        met = brought.join(sent.read(), ["doc_id", "print"]).select("hub", "cell", "leaf", "held")
        return met.repartition("hub", "cell").sortWithinPartitions("hub", "cell", F.col("leaf").asc_nulls_first()).mapInArrow(_compared(kind, test), "hub long, leaf long")


def components(docs: DataFrame, close: Callable[[DataFrame], DataFrame], block: int = BLOCK) -> DataFrame:
    """doc_id, print (hash of the text), component (a key that its sets share), component_id (smallest doc_id that
    near copies reach) for the rows with a doc_id. Where ids are repeated, two components may have one component_id.
    ``close`` links distinct fingerprints: from (fp) to (a, b)."""
    docs = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("print"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = Staged(docs.mapInArrow(_prefixes(common_shingles(docs, block)), f"doc_id {kind}, print long, key long, fp long, sketch binary, n int, prefix array<long>, part array<byte>"), "near-prefix")
    keys = Staged(cut.read().select("doc_id", "print", "key"), "near-keys")
    firsts = Staged(cut.read().groupBy("key", "fp").agg(F.min(F.struct("doc_id", "print")).alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.max(F.slice("prefix", 1, HEADS)).alias("head")), "near-first")
    sets = Sets(docs, firsts.read(), block)
    packed = F.shiftleft(F.col("at.part").cast("long") + 1, PART_AT).bitwiseOR(F.shiftleft(F.col("n").cast("long"), SIZE_AT)).bitwiseOR(F.col("pos").cast("long"))
    index = cut.read().select("key", "n", F.posexplode(F.arrays_zip("prefix", "part")).alias("pos", "at")).select(F.col("at.prefix").alias("token"), "key", packed.alias("size_at"))
    size = F.col("size_at").bitwiseAND((1 << PART_AT) - 1)
    band = F.floor(F.log(F.shiftright(size, SIZE_AT)) / F.log(F.lit(DENOMINATOR / NUMERATOR)))
    led = index.repartition("token", F.shiftright("size_at", PART_AT)).sortWithinPartitions("token", F.shiftright("size_at", PART_AT), band, F.xxhash64("key", F.pmod("token", F.lit(TURNS))), "key")
    met = Staged(led.mapInArrow(_lead, "token long, part long, key long, size_at long, hub long, mate long"), "near-met")
    cut.drop()
    prints = firsts.read().groupBy("fp").agg(F.min("key").alias("hub"))
    linked = close(prints.select("fp")).join(prints.withColumnsRenamed({"fp": "a"}), "a").join(prints.select(F.col("fp").alias("b"), F.col("hub").alias("leaf")), "b").select("hub", "leaf")
    same = firsts.read().join(prints, "fp").where("key != hub").select("hub", F.col("key").alias("leaf"))
    led = met.read().select(F.explode(F.array("hub", "mate")).alias("hub"), F.col("key").alias("leaf")).where("leaf != hub")
    pairs = Staged(sets.plausible(led.unionByName(linked).unionByName(same).select(F.least("hub", "leaf").alias("hub"), F.greatest("hub", "leaf").alias("leaf")).distinct()), "near-close")
    first_links = Staged(sets.near(pairs), "near-links")
    pairs.drop()
    found = Staged(connected_components(first_links.read()), "near-places")
    placed = met.read().select("token", "part", "key", "size_at").join(found.read().withColumnRenamed("node", "key"), "key", "left").select("token", "part", "key", "size_at", F.coalesce("component", "key").alias("place"))
    head = F.array(*[F.coalesce(F.get("head", F.lit(i)), F.lit(0)) for i in range(HEADS)]).alias("head")
    held = Staged(placed.join(firsts.read().select("key", "sketch", head), "key"), "near-placed")
    met.drop()
    light = held.read().where("part < 0").drop("part").repartition("token").sortWithinPartitions("token", "place").mapInArrow(_small, "hub long, leaf long")
    heavy = _dealt(held.read().where("part >= 0").drop("part"), block).mapInArrow(_large, "hub long, leaf long")
    rest = Staged(light.unionByName(heavy).select(F.least("hub", "leaf").alias("hub"), F.greatest("hub", "leaf").alias("leaf")).distinct(), "near-rest")
    held.drop()
    stars = found.read().select(F.col("node").alias("a"), F.col("component").alias("b"))
    place = connected_components(sets.near(rest).unionByName(stars))
    whole = firsts.read().select("key", "first").join(place.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = whole.groupBy("component").agg(F.min("first.doc_id").alias("component_id"))
    by_key = Staged(whole.join(least, "component").select("key", "component", "component_id"), "near-component").read()
    for table in (rest, first_links, found, firsts, *sets.used):
        table.drop()
    return keys.read().join(by_key, "key").select("doc_id", "print", "component", "component_id")
