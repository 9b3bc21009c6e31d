"""Repeated passages by sparse suffix arrays.

Of each document's suffixes only those at content-selected positions are retained: of every ``WINDOW``
consecutive seeds (``SEED_WORDS`` words each) the one of least hash. As seed and window span ``MINIMUM``
words together, every passage of that length retains the suffix at the same place in each of its copies.
Retained suffixes whose seed is unique in the corpus are dropped by one aggregation over hashes. The others
get their words to the right and left, are sorted by the words from the seed on, and neighbours are compared word by word:
how many words they share to the right. The same to the left extends the match. Suffixes that share ``MINIMUM`` words in all, for each
place of the seed among them, are repeats; overlapping ones are united, left and right, to whole passages.

Seeds with more than ``HEAVY`` distinct surroundings are not brought together in a task. All stretches with some number of words left
of the seed, from a to b, have a words there and ``SIDE`` - b on the right in common and take in b and ``SIDE`` - a at most: surroundings
are told apart by the former, become one where they agree in the latter, and are compared if no more than ``HEAVY`` are left. Else the
range of a to b is halved again; where a is b only one is left, so this ends at any size and finds the same. Words around a seed are
compared by 32 bits of their hash, seeds by 64: two stretches that differ in a word pass for equal once in four billion.

Words are as between white space. Null and empty texts and texts under ``MINIMUM`` words have no passages;
a null doc_id has none either (it cannot be told from another document); rows that share a doc_id count as
one document, so a passage must stand under two ids; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import chunks
from .common import Staged
from .words import BASE, Powers, mix, portions, stretch_hashes

MINIMUM, SEED_WORDS, HEAVY = 50, 25, 2000
WINDOW = MINIMUM - SEED_WORDS + 1
SIDE = MINIMUM - SEED_WORDS


def _runs(words: np.ndarray, powers: Powers) -> np.ndarray:
    """A hash of each seed."""
    if len(words) < SEED_WORDS:
        return np.empty(0, "u8")
    starts = np.arange(len(words) - SEED_WORDS + 1)
    return stretch_hashes(words, starts, starts + SEED_WORDS, powers)


def _sliding(x: np.ndarray, n: int, least: bool) -> np.ndarray:
    """The least or greatest of each n neighbours, from running ones within blocks of n, forwards and backwards."""
    better, worst = (np.minimum, ~np.uint64(0)) if least else (np.maximum, np.uint64(0))
    blocks = np.append(x, np.full(-len(x) % n, worst, "u8")).reshape(-1, n)
    forward = better.accumulate(blocks, axis=1).ravel()
    backward = better.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(x) - n + 1
    return better(backward[:count], forward[n - 1 : n - 1 + count])


def _selected(words: np.ndarray, begins: np.ndarray, counts: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose seed is the least of some window of seeds within one text, and all seeds."""
    seeds = _runs(words, powers)
    if len(seeds) < WINDOW:
        return np.empty(0, np.int64), seeds
    least = _sliding(seeds, WINDOW, True)
    inside = np.zeros(len(words) + 1, np.int64)
    long = counts >= MINIMUM
    np.add.at(inside, begins[long], 1)
    np.add.at(inside, begins[long] + counts[long] - MINIMUM + 1, -1)
    least = np.where(np.cumsum(inside)[: len(least)] > 0, least, np.uint64(0))
    edge = np.zeros(WINDOW - 1, "u8")
    return np.flatnonzero(_sliding(np.concatenate((edge, least, edge)), WINDOW, False)[: len(seeds)] == seeds), seeds


def _retain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in batches:
        docs = batch.column("doc_id").to_numpy()
        for portion in portions(batch.column("text"), powers):
            first, counts = portion.first, portion.counts
            words, begins = portion.spaced(1)
            at, seeds = _selected(words, begins, counts, powers)
            row = np.searchsorted(begins, at, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(docs[first + row]), pa.array((at - begins[row]).astype("i4")), pa.array(seeds[at].view("i8"))], ["doc_id", "pos", "seed"])


def _surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the given suffixes of each text: the words around the seed, zeros beyond the text's ends."""
    powers = Powers()
    places = np.concatenate((np.arange(-SIDE, 0), np.arange(SEED_WORDS, SEED_WORDS + SIDE)))
    for batch in batches:
        docs, wanted = batch.column("doc_id").to_numpy(), batch.column("wanted")
        for portion in portions(batch.column("text"), powers):
            first, counts = portion.first, portion.counts
            words, begins = portion.spaced(SIDE)
            part = wanted.slice(first, len(counts))
            row = np.repeat(np.arange(len(counts)), pc.list_value_length(part).to_numpy())
            flat = part.flatten()
            pos, seed = flat.field("pos").to_numpy(), flat.field("seed").to_numpy()
            # another row of the same doc_id may lack the suffix
            fits = pos + SEED_WORDS <= counts[row]
            row, pos, seed = row[fits], pos[fits], seed[fits]
            seeds = _runs(words, powers)
            same = seeds[begins[row] + pos].view("i8") == seed
            row, pos, seed = row[same], pos[same], seed[same]
            full = np.concatenate((np.zeros(SIDE, "u8"), words)).astype("<u4")
            around = full[(begins[row] + pos + SIDE)[:, None] + places]
            fixed = pa.Array.from_buffers(pa.binary(8 * SIDE), len(row), [None, pa.py_buffer(around.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(docs[first + row]), pa.array(pos.astype("i4")), pa.array(seed), fixed.cast(pa.binary())], ["doc_id", "pos", "seed", "around"])


def _stretches(around: list[bytes]) -> np.ndarray:
    """Column o: a hash of the stretch that has o words left of the seed and the rest right of it; 0 where the text ends inside it."""
    words = np.frombuffer(b"".join(around), "<u4").reshape(-1, 2 * SIDE).astype("u8")
    left, right = words[:, :SIDE][:, ::-1], words[:, SIDE:]
    power = np.multiply.accumulate(np.full(SIDE, BASE, "u8"))
    lefts = np.concatenate((np.zeros((len(words), 1), "u8"), np.cumsum(left * power, axis=1, dtype="u8")), axis=1)
    rights = np.concatenate((np.zeros((len(words), 1), "u8"), np.cumsum(right * power, axis=1, dtype="u8")), axis=1)
    made = mix(lefts * np.uint64(0xD6E8FEB86659FD93) + rights[:, ::-1] + np.arange(SIDE + 1, dtype="u8"))
    inside = np.concatenate((np.ones((len(words), 1), bool), np.cumsum(left == 0, axis=1) == 0), axis=1) & np.concatenate((np.ones((len(words), 1), bool), np.cumsum(right == 0, axis=1) == 0), axis=1)[:, ::-1]
    return np.where(inside, made | np.uint64(1), np.uint64(0))


def _shared(words: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows by run and words, how many words each then shares with the row before (-1 in another run), and the length of each row."""
    order = np.lexsort((*words.T[::-1], run))
    line, runs = words[order], run[order]
    same = np.column_stack((line[1:] == line[:-1], np.zeros(len(line) - 1, bool)))
    shared = np.where(runs[1:] == runs[:-1], same.argmin(axis=1), -1)
    return order, np.append(-1, shared), (words != 0).sum(axis=1)


def _interval(order: np.ndarray, shared: np.ndarray, least: int) -> np.ndarray:
    """A number for each row that it has in common with rows that share ``least`` words with it."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(shared < least)
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sort the suffixes of each seed, compare neighbours to the right and to the left; those that share enough under two ids are repeats."""
    for chunk in chunks(batches, "seed"):
        first, last, seed = (chunk.column(c).to_numpy() for c in ("first", "last", "seed"))
        run = np.cumsum(np.append(True, seed[1:] != seed[:-1]))
        words = np.frombuffer(b"".join(chunk.column("around").to_pylist()), "<u4").reshape(-1, 2 * SIDE)
        right, right_shared, right_size = _shared(words[:, SIDE:], run)
        left, left_shared, left_size = _shared(words[:, :SIDE][:, ::-1], run)
        found, head = np.zeros((len(run), SIDE + 1), bool), np.zeros((len(run), SIDE + 1), np.int64)
        for o in range(SIDE + 1):
            inside = np.flatnonzero((left_size >= o) & (right_size >= SIDE - o))
            key = _interval(right, right_shared, SIDE - o)[inside] * (len(run) + 1) + _interval(left, left_shared, o)[inside]
            order = np.argsort(key, kind="stable")
            column, rows = key[order], inside[order]
            start = np.flatnonzero(np.append(True, column[1:] != column[:-1])) if len(column) else np.empty(0, np.int64)
            if not start.size:
                continue
            low, high = np.minimum.reduceat(first[rows], start), np.maximum.reduceat(last[rows], start)
            size = np.diff(np.append(start, len(rows)))
            found[rows, o], head[rows, o] = np.repeat(low != high, size), np.repeat(low, size)
        rows = np.flatnonzero(found.any(axis=1))
        if rows.size:
            count = np.append(0, np.cumsum(found[rows].sum(axis=1))).astype("i4")
            offsets = pa.ListArray.from_arrays(pa.array(count), pa.array(np.nonzero(found[rows])[1].astype("i4")))
            heads = pa.ListArray.from_arrays(pa.array(count), pa.array(head[rows][found[rows]]))
            kept = chunk.select(["seed", "around"]).take(pa.array(rows)).combine_chunks()
            yield pa.RecordBatch.from_arrays([*[kept.column(c).chunk(0) for c in ("seed", "around")], offsets, heads], ["seed", "around", "offsets", "heads"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both halves of a range of offsets: the words around the seed that stretches of the half take in (``part``, zeros beyond), and a hash
    of those that all of its stretches have (``key``). Rows whose text ends inside the latter have no stretch there and are left out."""
    before, away = np.arange(2 * SIDE) < SIDE, np.concatenate((np.arange(SIDE, 0, -1), np.arange(1, SIDE + 1)))
    power = np.multiply.accumulate(np.full(2 * SIDE, BASE, "u8"))
    for batch in batches:
        words = np.frombuffer(b"".join(batch.column("around").to_pylist()), "<u4").reshape(-1, 2 * SIDE)
        low, high = (batch.column(c).to_numpy().astype("i8")[:, None] for c in ("low", "high"))
        middle = (low + high) // 2
        for a, b in ((low, middle), (middle + 1, high)):
            common = away <= np.where(before, a, SIDE - b)
            rows = np.flatnonzero(((words != 0) | ~common).all(axis=1))
            part = np.where(away <= np.where(before, b, SIDE - a), words, 0)[rows].astype("<u4")
            sums = (np.where(common, words, 0)[rows] * power).sum(axis=1, dtype="u8")
            key = mix(mix(sums + (a * (SIDE + 1) + b)[rows, 0].astype("u8")) + batch.column("seed").to_numpy().view("u8")[rows])
            fixed = pa.Array.from_buffers(pa.binary(8 * SIDE), len(rows), [None, pa.py_buffer(part.tobytes())])
            kept = [batch.column(c).take(pa.array(rows)) for c in ("seed", "around", "first", "last")]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(x[rows, 0].astype("i4")) for x in (a, b)], pa.array(key.view("i8")), fixed.cast(pa.binary())], ["seed", "around", "first", "last", "low", "high", "key", "part"])


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes with equal surroundings under two ids: all their stretches are repeats."""
    for batch in batches:
        key = _stretches(batch.column("around").to_pylist())
        offsets = [np.flatnonzero(k).tolist() for k in key]
        heads = [[f] * len(o) for f, o in zip(batch.column("first").to_pylist(), offsets)]
        yield pa.RecordBatch.from_arrays([batch.column("seed"), batch.column("around"), pa.array(offsets, pa.list_(pa.int32())), pa.array(heads, pa.list_(pa.int64()))], ["seed", "around", "offsets", "heads"])


KINDS = "seed long, around binary, offsets array<int>, heads array<long>"
CUT = "seed long, around binary, first long, last long, low int, high int, key long, part binary"


def _crowded(shape: DataFrame, heavy: int) -> Staged:
    """Seeds with more than ``heavy`` rows. A table of known size: where it is small, as few seeds are in many texts, rows of such seeds do not meet on its account."""
    return Staged(shape.groupBy("seed").count().where(F.col("count") > heavy).select("seed"), "suffix-crowded")


def _compared(shape: DataFrame, many: DataFrame) -> DataFrame:
    return shape.join(many, "seed", "left_anti").repartition("seed").sortWithinPartitions("seed", "around").mapInArrow(_compare, KINDS)


def narrowed(shape: DataFrame, many: DataFrame, heavy: int) -> list[Staged]:
    """Repeats among surroundings of crowded seeds, in tables by how far the range of offsets was halved: a row for each surrounding and range that has some."""
    found, used = [], []
    rows = shape.join(many, "seed", "left_semi").withColumns({"low": F.lit(0), "high": F.lit(SIDE)})
    while not many.isEmpty():
        cut = Staged(rows.mapInArrow(_cut, CUT), "suffix-cut")
        # what differs only in words that no stretch of the range takes in is one row
        parts = Staged(cut.read().groupBy(F.col("key").alias("seed"), F.col("part").alias("around")).agg(F.min("first").alias("first"), F.max("last").alias("last")), "suffix-parts")
        crowded = _crowded(parts.read(), heavy)
        many = crowded.read()
        made = _compared(parts.read(), many).withColumnsRenamed({"seed": "key", "around": "part"})
        found.append(Staged(cut.read().join(made, ["key", "part"]).select("seed", "around", "offsets", "heads"), "suffix-narrowed"))
        rows = cut.read().join(many.withColumnRenamed("seed", "key"), "key", "left_semi").drop("key", "part")
        for table in (*used, parts):
            table.drop()
        used = [cut, crowded]
    for table in used:
        table.drop()
    return found


def suffixes(docs: DataFrame) -> tuple[DataFrame, tuple[Staged, ...]]:
    """(seed, doc_id, pos) of retained suffixes whose seed stands under two ids, and the tables to drop after use."""
    held = Staged(docs.mapInArrow(_retain, "doc_id long, pos int, seed long"), "suffixes")
    twice = held.read().groupBy("seed").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a != b").select("seed")
    seeds = Staged(twice, "suffix-seeds")
    return held.read().join(seeds.read(), "seed", "left_semi"), (held, seeds)


def repeats(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """A row for each retained suffix in a repeated passage: doc_id, pos, offsets (words left of the seed in each repeated stretch), heads (an earlier doc_id that has the stretch, or its own)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    found, used = suffixes(rows)
    wanted = found.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "seed")).alias("wanted"))
    around = Staged(rows.join(wanted, "doc_id").mapInArrow(_surround, "doc_id long, pos int, seed long, around binary"), "suffix-words").read()
    for table in used:
        table.drop()
    shapes = Staged(around.groupBy("seed", "around").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "suffix-kinds")
    shape = shapes.read()
    crowded = _crowded(shape, heavy)
    many = crowded.read()
    narrow = narrowed(shape, many, heavy)
    kinds = _compared(shape, many).unionByName(shape.where("first != last").mapInArrow(_own, KINDS))
    for table in narrow:
        kinds = kinds.unionByName(table.read())
    kinds = Staged(kinds, "suffix-repeats")
    for table in (shapes, crowded, *narrow):
        table.drop()
    return around.join(kinds.read(), ["seed", "around"]).select("doc_id", "pos", "offsets", "heads")


def scan(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """One row for each document with a repeated passage.

    Columns: doc_id, n_passages, n_words (in passages), spans (``start:end`` in words, end exclusive,
    comma-joined in order), extra_words (in stretches that a document of smaller id has too: what a
    deduplication that keeps first copies would cut).
    """
    found = repeats(docs, heavy)
    extra = F.filter(F.arrays_zip("offsets", "heads"), lambda x: x["heads"] < F.col("doc_id"))["offsets"]
    rows = found.withColumn("extra", extra).select(
        "doc_id",
        F.inline(F.array(*[F.struct((F.col("pos") - F.array_max(c)).alias("start"), (F.col("pos") - F.array_min(c) + MINIMUM).alias("end"), F.lit(c == "extra").alias("cut")) for c in ("offsets", "extra")])),
    ).where("start is not null")
    order = Window.partitionBy("doc_id", "cut").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = rows.repartition("doc_id").withColumn("fresh", F.when(reach >= F.col("start"), 0).otherwise(1)).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    passages = islands.groupBy("doc_id", "cut", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    words = F.col("end") - F.col("start")
    kept = F.when(~F.col("cut"), F.struct("start", F.concat_ws(":", "start", "end").alias("said")))
    return passages.groupBy("doc_id").agg(
        F.count(kept).alias("n_passages"),
        F.sum(F.when(~F.col("cut"), words).otherwise(0)).cast("long").alias("n_words"),
        F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["said"]), ",").alias("spans"),
        F.sum(F.when(F.col("cut"), words).otherwise(0)).cast("long").alias("extra_words"),
    )


def scan_sql() -> str:
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + {MINIMUM}], ' ') AS x FROM (SELECT doc_id, w, unnest(range(0, len(w) - {MINIMUM - 1})) AS i FROM d)),
h AS (SELECT x, min(doc_id) AS head FROM s GROUP BY x HAVING min(doc_id) != max(doc_id)),
r AS (SELECT doc_id, i, i + {MINIMUM} AS e, false AS cut FROM s JOIN h USING (x) UNION SELECT doc_id, i, i + {MINIMUM}, true FROM s JOIN h USING (x) WHERE head < doc_id),
f AS (SELECT *, CASE WHEN max(e) OVER (PARTITION BY doc_id, cut ORDER BY i, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= i THEN 0 ELSE 1 END AS fresh FROM r),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, cut ORDER BY i, e ROWS UNBOUNDED PRECEDING) AS island FROM f),
p AS (SELECT doc_id, cut, min(i) AS a, max(e) AS b FROM g GROUP BY doc_id, cut, island)
SELECT doc_id, count(*) FILTER (NOT cut) AS n_passages, sum(b - a) FILTER (NOT cut)::BIGINT AS n_words,
    string_agg(a || ':' || b, ',' ORDER BY a) FILTER (NOT cut) AS spans, coalesce(sum(b - a) FILTER (cut), 0)::BIGINT AS extra_words FROM p GROUP BY doc_id"""
