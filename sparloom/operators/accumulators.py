"""Mergeable accumulators: what a rank, a repeat or a micro-batch keeps of its samples, and what all of them come to.

A state holds, for each column, the count, the sum, the least and the greatest value
and a KLL sketch.  States are rows, so they are written by whoever made them and
merged in any order and grouping: counts and sums add, sketches merge.  Means and
extremes are exact; a quantile's rank is off by RANK_ERROR of all samples at most
(at 99 % confidence, for sketches of size K).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, RANK_ERROR = 400, 0.0082


def accumulated(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """One row a group: by..., and for each value a state; nulls and NaN do not count."""
    def state(c: str):
        x = F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        return F.struct(F.count(x).alias("n"), F.sum(x).alias("total"), F.min(x).alias("least"), F.max(x).alias("most"), F.kll_sketch_agg_double(x, K).alias("sketch")).alias(c)

    return rows.groupBy(*by).agg(*[state(c) for c in values])


def merged(states: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """The states of each group as one, whatever made them."""
    def state(c: str):
        return F.struct(F.sum(f"{c}.n").alias("n"), F.sum(f"{c}.total").alias("total"), F.min(f"{c}.least").alias("least"), F.max(f"{c}.most").alias("most"), F.kll_merge_agg_double(f"{c}.sketch").alias("sketch")).alias(c)

    return states.groupBy(*by).agg(*[state(c) for c in values])


def mean(value: str):
    """Mean of a state; null without samples."""
    return F.when(F.col(f"{value}.n") > 0, F.col(f"{value}.total") / F.col(f"{value}.n"))


def quantile(value: str, at: float):
    """A quantile of a state within RANK_ERROR; null without samples."""
    return F.when(F.col(f"{value}.n") > 0, F.kll_sketch_get_quantile_double(f"{value}.sketch", F.lit(at)))
