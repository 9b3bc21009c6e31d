"""Positions of regular-expression matches, with built-in functions only.

``split`` gives the pieces between matches and ``regexp_extract_all`` the matches, so a
running sum of their lengths gives each match's place in code points. The sum is a window
over the matches of one text; a text itself never leaves the scan stage.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """One kind of span.

    pattern: what proposes spans, leftmost and non-overlapping.
    needs: a string that every text with a match contains, to skip the search cheaply.
    valid: match -> boolean column, None for all.
    context: (words pattern, characters before the span that are looked at), None for none.
    """

    name: str
    pattern: str
    needs: str | None = None
    valid: Callable[[Column], Column] | None = None
    context: tuple[str, int] | None = None


def _matches(text: Column, number: int, kind: Kind) -> Column:
    empty = F.array().cast("array<struct<kind:int,pos:int,gap:int,len:int,ok:boolean,near:boolean>>")

    def one(piece: Column, found: Column) -> Column:
        ok = F.lit(True) if kind.valid is None else F.coalesce(kind.valid(found), F.lit(False))
        near = F.lit(False) if kind.context is None else F.lower(F.right(piece, F.lit(kind.context[1]))).rlike(kind.context[0])
        return F.struct(F.lit(number).alias("kind"), F.lit(0).alias("pos"), F.length(piece).alias("gap"), F.length(found).alias("len"), ok.alias("ok"), near.alias("near"))

    pieces = F.split(text, kind.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    rows = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, one)
    has = text.rlike(kind.pattern)
    if kind.needs:
        has = text.contains(kind.needs) & has
    return F.when(has, rows).otherwise(empty)


def located(df: DataFrame, text: Column, kinds: Sequence[Kind]) -> DataFrame:
    """A row for each match of each kind: row_key, doc_id, kind, start, end, ok, near.

    A text without a match gives one row with nulls. The result is dealt out by row_key.
    """
    keyed = df.select(F.monotonically_increasing_id().alias("row_key"), "doc_id", text.alias("text"))
    found = F.concat(*[_matches(F.col("text"), n, k) for n, k in enumerate(kinds)])
    rows = keyed.select("row_key", "doc_id", F.posexplode_outer(found).alias("pos", "m")).select("row_key", "doc_id", "pos", "m.kind", "m.gap", "m.len", "m.ok", "m.near")
    so_far = Window.partitionBy("row_key", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.col("len")).over(so_far)
    return rows.repartition("row_key").select("row_key", "doc_id", "kind", (end - F.col("len")).alias("start"), end.alias("end"), "ok", "near")


def joined(order: Sequence[str], kinds: Sequence[Kind], only: Column) -> Column:
    """Aggregate: the spans for which ``only`` holds as ``kind:start:end``, comma-joined in the given order."""
    names = F.array(*[F.lit(k.name) for k in kinds])
    said = F.concat_ws(":", F.element_at(names, F.col("kind") + 1), F.col("start"), F.col("end"))
    item = F.struct(*[F.col(c) for c in order], F.col("end"), said.alias("said"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(only, item))), lambda x: x["said"]), ",")


def spans_sql(kinds: Sequence[Kind], patterns: Sequence[str] | None = None, context_of: str = "''") -> str:
    """DuckDB: common table expressions ending in ``s`` (rk, doc_id, k, start, end, m, before)."""
    parts = " UNION ALL ".join(
        f"SELECT rk, {n} AS k, string_split_regex(t, '{p}') AS pc, regexp_extract_all(t, '{p}') AS m FROM d WHERE regexp_matches(t, '{p}')"
        for n, p in enumerate(x.replace("'", "''") for x in (patterns or [k.pattern for k in kinds]))
    )
    return f"""WITH d AS (SELECT row_number() OVER () AS rk, doc_id, coalesce(text, '') AS t FROM documents),
p AS ({parts}),
q AS (SELECT rk, k, unnest(range(1, len(m) + 1)) AS i, pc, m FROM p),
r AS (SELECT rk, k, i, pc[i] AS before, m[i] AS m FROM q),
s AS (SELECT rk, k, before, m, sum(length(before) + length(m)) OVER (PARTITION BY rk, k ORDER BY i) AS "end" FROM r),
"""
