"""Secret scan: multipart credential linking.

Strong spans (assigned secrets, access identifiers, long hex strings) are always reported.
Weak parts (a bare mixed token, a login name, an endpoint address) say little alone: each is
joined by interval with the other parts of its text, and reported only when a complementary
part starts within ``scope`` code points. The interval join is a range frame over the parts of
one text, so its work is the parts that lie within the scope, not all pairs.

Null text counts as empty and gives no spans; a null doc_id is carried; repeated rows each give
their own result row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import either_case, text_or_empty
from .spans import Kind, joined, located, spans_sql

ASSIGN = f"({either_case('password')}|{either_case('passwd')}|{either_case('secret')}|{either_case('token')}|{either_case('api_?key')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
LOGIN = f"(?:{either_case('username')}|{either_case('login')}|{either_case('client_?id')}|{either_case('account')})[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9._@+-]+"

#: In this order; the first three are the strong ones.
KINDS = (
    Kind("assign", ASSIGN, valid=lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
    Kind("access", "AKIA[A-Z0-9]{16,}", needs="AKIA"),
    Kind("hex", "[0-9a-f]{24,}"),
    Kind("bare", "[A-Za-z0-9+/_]{32,}", valid=lambda m: m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]")),
    Kind("login", LOGIN),
    Kind("endpoint", r"(?:https?|ftp|ssh|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+", needs="://"),
)
SCOPE = 200


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text).

    Columns: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked (weak parts reported).
    """
    at = lambda c: F.when(F.col("ok"), F.col(c)).alias(c)  # noqa: E731  a failing match keeps its row, so that its text keeps one
    parts = located(docs.select("doc_id", "text"), text_or_empty(), KINDS).select("row_key", "doc_id", *[at(c) for c in ("kind", "start", "end")])
    parts = parts.withColumn("kind", F.when(_reported(scope), F.col("kind")))
    return parts.groupBy("row_key").agg(
        F.first("doc_id").alias("doc_id"),
        *[F.count(F.when(F.col("kind") == n, 1)).alias(f"n_{KINDS[n].name}") for n in range(3)],
        F.sha2(joined(("start", "kind"), KINDS, F.col("kind") < 3), 256).alias("base_sha256"),
        joined(("start", "kind"), KINDS, F.col("kind").isNotNull()).alias("spans"),
        F.count(F.when(F.col("kind") >= 3, 1)).alias("n_linked"),
    ).drop("row_key")


def _reported(scope: int) -> Column:
    """Strong spans, and weak parts with a complementary part in scope; a bare token that a strong span covers is that span's own."""
    within = Window.partitionBy("row_key").orderBy("start").rangeBetween(-scope, scope)
    before = Window.partitionBy("row_key").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    has = lambda *kinds: F.coalesce(F.max(F.col("kind").isin(*kinds)).over(within), F.lit(False))
    secret, bare, identifier, endpoint = has(0, 2), has(3), has(1, 4), has(5)
    covered = F.coalesce(F.max(F.when(F.col("kind") < 3, F.col("end"))).over(before) > F.col("start"), F.lit(False))
    return (
        (F.col("kind") < 3)
        | ((F.col("kind") == 3) & (identifier | endpoint) & ~covered)
        | ((F.col("kind") == 4) & (secret | bare))
        | ((F.col("kind") == 5) & (secret | (bare & identifier)))
    )


def scan_sql(scope: int = SCOPE) -> str:
    near = lambda *kinds: f"coalesce(bool_or(k IN ({', '.join(map(str, kinds))})) OVER w, false)"
    names = "[" + ", ".join(f"'{k.name}'" for k in KINDS) + "]"
    assign = ASSIGN.replace("'", "''")
    said = f"{names}[k + 1] || ':' || start || ':' || \"end\""
    return (
        spans_sql(KINDS)
        + f"""v AS (SELECT rk, k, "end" - length(m) AS start, "end" FROM s WHERE CASE k
    WHEN 0 THEN length(regexp_extract(m, '{assign}', 2)) >= 6
    WHEN 3 THEN regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') ELSE true END),
n AS (SELECT *, {near(0, 2)} AS secret, {near(3)} AS bare, {near(1, 4)} AS ident, {near(5)} AS place,
    coalesce(max(CASE WHEN k < 3 THEN "end" END) OVER (PARTITION BY rk ORDER BY start RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) > start, false) AS covered
    FROM v WINDOW w AS (PARTITION BY rk ORDER BY start RANGE BETWEEN {scope} PRECEDING AND {scope} FOLLOWING)),
f AS (SELECT rk, k, start, {said} AS said FROM n WHERE k < 3 OR (k = 3 AND (ident OR place) AND NOT covered) OR (k = 4 AND (secret OR bare)) OR (k = 5 AND (secret OR (bare AND ident))))
SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    sha256(coalesce(string_agg(said, ',' ORDER BY start, k) FILTER (k < 3), '')) AS base_sha256,
    coalesce(string_agg(said, ',' ORDER BY start, k), '') AS spans, count(*) FILTER (k >= 3) AS n_linked
FROM d LEFT JOIN f USING (rk) GROUP BY rk, doc_id"""
    )
