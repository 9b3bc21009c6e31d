"""A training corpus from raw documents in five stages, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barwright.llm import decontam, langid, mixing, simhash, tokens
from barwright.llm.common import Staged, table


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return langid.accepted(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: five-word shingles, Jaccard similarity 0.8 or more."""
    return simhash.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at the target weights of their sources, repeats included, in order of virtual finish time."""
    return mixing.documents(docs)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token-id file holds: doc_id, start, n_tokens, ids_crc32."""
    return tokens.scan(docs)


STAGES = [
    ("language", by_language),
    ("near-dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("tokens", as_tokens),
]

#: Language models, fingerprints and tokens have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = Staged(docs, f"pipeline-{name}").read()
    return docs
