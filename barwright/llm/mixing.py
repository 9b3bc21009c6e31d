"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a queue shuffled by a hash, and a queue is passed ``most`` times. Queues
are served in packets: a document in one pass, in two if it straddles its source's target. A packet's
virtual finish time is the words queued up to its end divided by the target. All packets are range-sorted by
it, words are summed along that order, and the mix is cut where the budget is spent (the targets' whole words).

Both running sums are in two levels: totals by hash bucket of a source, or by range of the order, first,
then within one. A source that holds most rows is dealt out as evenly as the others.

Null and empty texts have size 0 and nothing is taken of them; a null source is a source of its own,
last in order; a null doc_id is carried and its row queued by its text; repeated rows each stand in the queue; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Staged, text_or_empty

WEIGHTS, BUDGET, MOST, SEED = (5, 2, 1), 1.5, 2, "mix"
WORD = r"[^\x20\x09-\x0D]+"


def _queue(docs: DataFrame, seed: str) -> DataFrame:
    """doc_id, source, known (false for a null source), size, key (hex digest that gives the order), bucket, print (hash of the text), row (a number)."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null|"), F.md5(text_or_empty())))
    key = F.md5(F.concat(F.lit(seed + "|"), name))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNotNull().alias("known"), F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"), key.alias("key"), F.xxhash64("text").alias("print"))
    return rows.withColumn("bucket", F.substring("key", 1, 3)).withColumn("row", F.monotonically_increasing_id())


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """From one row per source (source, known, source_size) adds ``target`` and ``budget``, the whole words of all targets.

    Sources in order of code points, null last, take the weights in turn. The budget is shared by
    weight; a target stops at ``most`` times its source's size and the excess is shared again. With
    sources in order of cap / weight the level is the highest of (budget - caps before) / (weights from here).
    The windows are over one row per source, never over documents.
    """
    order = Window.orderBy(F.col("known").desc(), "source")
    by_ratio = Window.orderBy("ratio", F.col("known").desc(), "source")
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    level = (F.lit(budget) * F.sum("source_size").over(everything) - before) / left
    rows = rows.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    rows = rows.withColumn("target", F.least("cap", F.col("level") * F.col("weight")))
    return rows.select("source", "known", "source_size", "target", F.sum(F.floor("target")).over(everything).cast("long").alias("budget"))


def _packets(rows: DataFrame, most: int) -> DataFrame:
    """Adds the packets of each row: words, finish. A row has one at least; one without words has no finish."""
    words = F.floor("target").cast("long")
    packets = []
    for n in range(most):
        begin = F.col("before") + F.col("source_size") * n
        inside = F.greatest(F.lit(0), F.least(F.col("size"), words - begin)).cast("long")
        for held, end in ((inside, begin + inside), (F.col("size") - inside, begin + F.col("size"))):
            packets.append(F.struct(held.alias("words"), F.when(held > 0, F.try_divide(end, "target")).alias("finish")))
    first = F.struct(F.lit(0).cast("long").alias("words"), F.lit(None).cast("double").alias("finish"))
    kept = F.filter(F.array(*packets), lambda x: x["finish"].isNotNull())
    return rows.select("*", F.inline(F.when(F.size(kept) > 0, kept).otherwise(F.array(first))))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, text).

    Columns: doc_id, source, size, source_size, target, taken, finish, print. ``taken`` counts repeats; the one
    document of each source that straddles its target gives only the words up to it. ``finish`` is the
    virtual finish time of the first packet, null where the row has no words or the target is 0; ``print`` is a hash of the text.
    """
    queue = Staged(_queue(docs, seed), "mix-queue").read()
    by_bucket = Staged(queue.groupBy("source", "known", "bucket").agg(F.sum("size").alias("held")), "mix-buckets").read()
    sizes = by_bucket.groupBy("source", "known").agg(F.sum("held").alias("source_size"))
    goal = targets(sizes, weights, budget, most)
    earlier = Window.partitionBy("source", "known").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = by_bucket.withColumn("ahead", F.coalesce(F.sum("held").over(earlier), F.lit(0))).drop("held").join(goal, ["source", "known"])
    inside = Window.partitionBy("source", "known", "bucket").orderBy("key", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    rows = queue.join(ahead, ["source", "known", "bucket"]).withColumn("before", F.col("ahead") + F.sum("size").over(inside) - F.col("size"))
    order = ("finish", "source", "known", "before")
    sorted_all = _packets(rows.drop("key", "bucket", "ahead"), most).repartitionByRange(*order).sortWithinPartitions(*order)
    packets = Staged(sorted_all.withColumn("range", F.spark_partition_id()), "mix-packets").read()
    # one row for each range of the order
    totals = packets.groupBy("range").agg(F.sum("words").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    served = F.sum("words").over(Window.partitionBy("range").orderBy(*order, "row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    placed = packets.withColumn("served", served).join(totals.select("range", before.alias("passed")), "range")
    part = F.greatest(F.lit(0), F.least(F.col("words"), F.col("budget") - F.col("passed") - F.col("served")))
    held = ("doc_id", "source", "known", "size", "source_size", "target", "print")
    summed = placed.withColumn("part", part).groupBy("row", *held).agg(F.sum("part").cast("long").alias("taken"), F.min("finish").alias("finish"))
    return summed.select("doc_id", F.when(F.col("known"), F.col("source")).alias("source"), "size", "source_size", "target", "taken", "finish", "print")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix as rows of ``docs``, repeats included, range-sorted by virtual finish time.

    Whole documents only: the straddling one is in if at least half of it was taken. Rows that agree in
    doc_id, source and text share what was taken of them evenly. Empty documents bring no words and go.
    """
    by = ("doc_id", "source", "print")
    taken = mix(docs, **settings).groupBy(*by).agg((F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).alias("_barwright_part"), F.min("finish").alias("_barwright_at"))
    same = docs["doc_id"].eqNullSafe(taken["doc_id"]) & docs["source"].eqNullSafe(taken["source"]) & (F.xxhash64(docs["text"]) == taken["print"])
    joined = docs.join(taken, same).select(*[docs[c] for c in docs.columns], "_barwright_part", "_barwright_at")
    times = F.floor(F.col("_barwright_part") + 0.5).cast("int")
    queued = joined.withColumn("_barwright_pass", F.explode(F.when(times > 0, F.sequence(F.lit(1), times))))
    return queued.orderBy(F.col("_barwright_at") + F.col("_barwright_pass"), "doc_id").select(docs.columns)


def scan_sql() -> str:
    weights = "[" + ", ".join(f"{float(w)}::DOUBLE" for w in WEIGHTS) + "]"
    passes = " + ".join(f"greatest(0, least(size, t - source_size * {n} - before))" for n in range(MOST))
    return f"""WITH q AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
    md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'null|' || md5(coalesce(text, '')))) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, {weights}[(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight FROM q GROUP BY source),
c AS (SELECT *, source_size * {float(MOST)}::DOUBLE AS cap FROM s),
l AS (SELECT *, ({BUDGET}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
g AS (SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM l),
r AS (SELECT doc_id, size, source_size, target, floor(target)::BIGINT AS t, (sum(size) OVER (PARTITION BY q.source ORDER BY key, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before
    FROM q JOIN g ON q.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, ({passes})::BIGINT AS taken FROM r"""
