"""A training corpus from raw documents, in five stages, each by one operator.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns
a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.

1. quality      rows that the quality rules reject go
2. near_dedup   one row of each group of near-duplicates stays (five-word
                shingles, likeness 0.8 or more): SimHash fingerprints are searched
                by vantage-point trees, and an exact check adds what these miss
3. pii          spans of personal data become [KIND]
4. mix          sources take their target shares: rows go, stay or repeat
5. bpe          texts become token ids; the text beside them is decoded from the ids

Defined cases are those of the operators; null columns stay null, n_chars follows
the text, and an empty table passes through.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparloom import session
from sparloom.llm import bpe, common, mixing, pii, quality, simhash

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _bounded(stage: Stage) -> Stage:
    """A stage that bounds Arrow batches by itself, for it may be called without the query around it."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        session.bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@_bounded
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.passing(docs)


@_bounded
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


@_bounded
def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in clean.columns else clean


@_bounded
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


@_bounded
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.coded(docs, *bpe.vocabulary())


STAGES = [
    ("quality", quality_rules),
    ("near_dedup", near_dedup),
    ("pii", redact),
    ("mix", mix),
    ("bpe", encode),
]

#: Fingerprints, boosted trees and merges have no SQL form; tests hold the result against a plain program.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
