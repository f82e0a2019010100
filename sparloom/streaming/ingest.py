"""Ingestion as a stream: rows are appended to the shards of a Parquet store, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ingest(rows: DataFrame, store: str, state: str, by: str = "shard", pieces: int = 4) -> DataFrame:
    """Appends a stream's rows to store/by=K and returns what is stored, after all input at hand.

    Each micro-batch has a folder named by its number and is written by overwriting
    it, so a batch that is tried again replaces its own rows.  A shard's rows are
    spread over `pieces` tasks, and so over as many files of a batch.
    """
    def put(batch: DataFrame, number: int) -> None:
        piece = F.pmod(F.xxhash64(*[c for c in batch.columns if c != by]), F.lit(pieces))
        batch.repartition(F.col(by), piece).write.mode("overwrite").partitionBy(by).parquet(f"{store}/batch={number}")

    job = rows.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()
    job.awaitTermination()
    return rows.sparkSession.read.parquet(store).drop("batch")
