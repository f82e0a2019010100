"""Dense row indices and shards without a single sorted task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut


def with_index(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds each row's place, from 0, in the order of unique columns.

    Rows are sorted by ranges and written once with their place in their range;
    ranges are numbered by their row counts.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number is not coalesced
    ranged = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)  # how these ids are made: the partition's number, then the row's
    counts = ranged.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    placed = ranged.withColumn("_p", part).join(F.broadcast(starts), "_p")
    return placed.withColumn(name, F.col("_from") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_p", "_at", "_from")


#: Bytes of a stored table from which one task makes an index: a segment or two, which it can sort in memory.
SEGMENT_BYTES = 8 << 20


def spread(df: DataFrame, most: int | None = None) -> DataFrame:
    """df over all cores where its scan has no more tasks than these: a small file's splits may all lie in one row group.

    most: bytes of the stored tables that a task gets, however large they are; of whole tables, since a plan counts a text column as 20 bytes a row.
    """
    cores, tasks = df.sparkSession.sparkContext.defaultParallelism, df._jdf.rdd().getNumPartitions()
    wanted = 0
    if most:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        wanted = -(-sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())) // most)
    return df.repartition(max(cores, wanted)) if tasks <= cores or tasks < wanted else df
