"""Vector arithmetic and deterministic embeddings as columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either is a zero vector."""
    both = norm(a) * norm(b)
    return F.when(both > 0, dot(a, b) / both).otherwise(F.lit(0.0))


def normalized(v: Column) -> Column:
    """v over its length; zero vectors stay."""
    n = norm(v)
    return F.transform(doubles(v), lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))


def byte_embedding(text: Column, dim: int = 16) -> Column:
    """Component j from byte j mod 32 of the SHA-256: -1 to 1."""
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: F.conv(F.substring(digest, 2 * (j % 32) + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1)


def hashed_rows(df: DataFrame, key: list[str], text: str, dim: int = 384, unit: bool = False) -> DataFrame:
    """key..., slot, value: signed token counts by md5 slot, zero sums left out; unit: over the row's length, as doubles.

    A row's counts are made where it is read, from each batch's distinct tokens, so nothing is shuffled.
    """
    from ..operators.lexical import hashed_counts

    names = [f"_{i}" for i in range(len(key))]
    kinds = [StructField(n, df.schema[k].dataType) for n, k in zip(names, key, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                some = batch.slice(i, 512)
                counts = hashed_counts(some.column(len(names)), dim)
                row, slot = np.nonzero(counts)
                value = counts[row, slot]
                if unit:
                    value = value / np.sqrt((counts.astype(float) ** 2).sum(axis=1))[row]
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(some.column(n).take(at) for n in names), pa.array(slot), pa.array(value)], [*names, "slot", "value"])

    kept = df.select(*[F.col(k).alias(n) for n, k in zip(names, key, strict=True)], F.col(text).alias("_text"))
    out = kept.mapInArrow(run, StructType([*kinds, StructField("slot", LongType()), StructField("value", DoubleType() if unit else LongType())]))
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, key, strict=True)], "slot", "value")


def hashed_unit_rows(df: DataFrame, key: list[str], text: str, dim: int = 384) -> DataFrame:
    """hashed_rows with value as a double over the row's length."""
    return hashed_rows(df, key, text, dim, unit=True)
