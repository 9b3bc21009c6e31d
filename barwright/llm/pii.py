"""Personal data: expressions propose spans, checksums confirm them, context words adjust the score.

Null text counts as empty and gives no spans; a null doc_id is carried; repeated rows each give
their own result row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .spans import Kind, joined, located, spans_sql

PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
BYTES = rf"^{PART}(?:\.{PART}){{3}}$"
DOUBLED = ("0123456789", "0246813579")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Of 13 to 19 digits: is the Luhn sum a multiple of ten? Left-padded zeros add nothing."""
    padded = F.lpad(digits, 20, "0")
    last = [F.substring(padded, 20 - i, 1) for i in range(20)]
    total = reduce(lambda a, b: a + b, [(F.translate(c, *DOUBLED) if i % 2 else c).cast("int") for i, c in enumerate(last)])
    return total % 10 == 0


def mod97(m: Column) -> Column:
    """ISO 7064 over an account number: the first four characters go last, letters count as 10 to 35, the rest is 1."""
    plain = F.regexp_replace(m, "\x20", "")
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97).cast("int")

    return F.aggregate(F.split(moved, "(?!$)"), F.lit(0), step) == 1


#: Characters of an account number by country (registry of ISO 13616), the first four included.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU HN LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _accounts() -> str:
    """Account numbers of the length of their country, so that words after them stay out. Codes that are not in
    the registry may have 15 to 34 characters, up to where a number of a known country begins."""
    known = "|".join(rf"(?:{'|'.join(codes.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items())
    known = rf"(?:{known})(?![A-Za-z0-9_])"
    others = rf"(?!{'|'.join(' '.join(IBAN_LENGTHS.values()).split())})[A-Z]{{2}}[0-9]{{2}}(?:(?:\x20(?!{known}))?[A-Z0-9]){{11,30}}(?![A-Za-z0-9_])"
    return rf"(?<![A-Za-z0-9_])(?=[A-Z]{{2}}[0-9]{{2}})(?:{known}|{others})"


def _count_between(low: int, high: int):
    return lambda m: F.length(_digits(m)).between(low, high)


#: In this order; the first four are the base kinds. Possessive repeats cannot back off, so that long runs stay linear.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", needs="@", context=(r"mail|contact|write|reach", 40)),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", needs=".", valid=lambda m: m.rlike(BYTES), context=(r"\bip\b|addr|host|server|login", 40)),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){12,}+", valid=lambda m: _count_between(13, 19)(m) & luhn(_digits(m)), context=(r"card|visa|credit|debit|pay|amex", 40)),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", needs="+", valid=_count_between(9, 15), context=(r"phone|tel|call|mobile|fax|dial", 40)),
    Kind("iban", _accounts(), valid=mod97, context=(r"iban|account|bank|konto|compte|cuenta", 40)),
)
#: The same proposals for an engine of linear time that knows no possessive repeats.
PLAIN = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    r"[0-9](?:[\x20-]?[0-9]){12,}",
    KINDS[3].pattern,
    r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b",
)
#: Score of a confirmed span by kind, in per cent, and what a context word adds.
SCORES, CONTEXT = (80, 60, 85, 60, 90), 10


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text).

    Columns: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_iban, n_context (spans that
    a context word precedes), score (highest confidence in per cent, 0 without spans).
    """
    at = lambda c: F.when(F.col("ok"), F.col(c)).alias(c)  # noqa: E731  a failing match keeps its row, so that its text keeps one
    parts = located(docs.select("doc_id", "text"), text_or_empty(), KINDS).select("row_key", "doc_id", *[at(c) for c in ("kind", "start", "end", "near")])
    base = F.coalesce(*[F.when(F.col("kind") == n, F.lit(x)) for n, x in enumerate(SCORES)])
    score = base + F.when(F.col("near"), CONTEXT).otherwise(0)
    return parts.groupBy("row_key").agg(
        F.first("doc_id").alias("doc_id"),
        *[F.count(F.when(F.col("kind") == n, 1)).alias(f"n_{KINDS[n].name}") for n in range(4)],
        F.sha2(joined(("kind", "start"), KINDS, F.col("kind") < 4), 256).alias("base_sha256"),
        joined(("kind", "start"), KINDS, F.col("kind").isNotNull()).alias("spans"),
        F.count(F.when(F.col("kind") == 4, 1)).alias("n_iban"),
        F.count(F.when(F.col("near"), 1)).alias("n_context"),
        F.coalesce(F.max(score), F.lit(0)).alias("score"),
    ).drop("row_key")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every base-kind proposal that is an address or a number replaced by its kind in angle brackets; null text stays null."""
    text = F.col("text")
    for kind in KINDS[:4]:
        text = F.regexp_replace(text, kind.pattern, f"<{kind.name}>")
    return docs.withColumn("text", text)


def scan_sql() -> str:
    digits, moved = "regexp_replace(m, '[^0-9]', '', 'g')", "replace(m, ' ', '')[5:] || replace(m, ' ', '')[:4]"
    names = "[" + ", ".join(f"'{k.name}'" for k in KINDS) + "]"
    near = " ".join(f"WHEN {n} THEN regexp_matches(lower(right(before, {k.context[1]})), '{k.context[0]}')" for n, k in enumerate(KINDS))
    return (
        spans_sql(KINDS, PLAIN)
        + f"""v AS (SELECT rk, k, "end" - length(m) AS start, "end", CASE k {near} END AS near FROM s WHERE CASE k WHEN 0 THEN true WHEN 1 THEN regexp_matches(m, '{BYTES}')
    WHEN 2 THEN length({digits}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({digits}) + 1),
        lambda i: CASE WHEN i % 2 = 1 THEN reverse({digits})[i]::INT ELSE (2 * reverse({digits})[i]::INT) % 10 + (2 * reverse({digits})[i]::INT) // 10 END)) % 10 = 0
    WHEN 3 THEN length({digits}) BETWEEN 9 AND 15
    ELSE list_reduce(list_prepend(0, list_transform(string_split({moved}, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)),
        lambda a, b: (CASE WHEN b < 10 THEN a * 10 + b ELSE a * 100 + b END) % 97) = 1 END),
f AS (SELECT rk, k, start, near, {list(SCORES)}[k + 1] + CASE WHEN near THEN {CONTEXT} ELSE 0 END AS score, {names}[k + 1] || ':' || start || ':' || "end" AS said FROM v)
SELECT doc_id, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone,
    sha256(coalesce(string_agg(said, ',' ORDER BY k, start) FILTER (k < 4), '')) AS base_sha256, coalesce(string_agg(said, ',' ORDER BY k, start), '') AS spans,
    count(*) FILTER (k = 4) AS n_iban, count(*) FILTER (near) AS n_context, coalesce(max(score), 0)::INT AS score
FROM d LEFT JOIN f USING (rk) GROUP BY rk, doc_id"""
    )
