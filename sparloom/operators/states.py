"""Key-value-cache states as rows: materialize, fork, transfer, merge, evict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

#: Fields that two states must share before they may be merged.
IDENTITY = ("model_id", "tokenizer_id", "model_config_hash", "position_encoding")


def materialize(states: DataFrame, layers: int, heads: int, hidden: int, dtype_bytes: int = 2) -> DataFrame:
    """Adds one block a layer to states (state_id, token_count): spans, shapes and bytes of keys and values."""
    tokens = F.greatest(F.lit(0), F.col("token_count"))

    def block(i: Column) -> Column:
        return F.struct(
            F.concat(F.col("state_id"), F.lit("-"), i.cast("string")).alias("block_id"),
            i.cast("long").alias("layer_id"),
            F.lit(0).cast("long").alias("token_start"),
            tokens.cast("long").alias("token_end"),
            F.array(F.lit(heads).cast("long"), tokens.cast("long"), F.lit(hidden // heads).cast("long")).alias("key_shape"),
            (tokens * hidden * dtype_bytes * 2).cast("long").alias("nbytes"),
        )

    return states.withColumn("blocks", F.transform(F.sequence(F.lit(0), F.lit(layers - 1)), block))


def total_bytes(blocks: Column) -> Column:
    return F.aggregate(blocks, F.lit(0).cast("long"), lambda s, b: s + b["nbytes"])


def span(blocks: Column) -> Column:
    """struct(start, end); (0, 0) without blocks."""
    zero = F.lit(0).cast("long")
    return F.struct(F.coalesce(F.array_min(F.transform(blocks, lambda b: b["token_start"])), zero).alias("start"), F.coalesce(F.array_max(F.transform(blocks, lambda b: b["token_end"])), zero).alias("end"))


def fork(states: DataFrame, branches: int) -> DataFrame:
    """Each state as `branches` states that share its blocks; lineage gains the parent."""
    forked = states.withColumn("branch_index", F.explode(F.sequence(F.lit(0), F.lit(branches - 1))))
    new_id = F.substring(F.sha2(F.concat_ws("/", "state_id", F.col("branch_index").cast("string")), 256), 1, 12)
    return forked.withColumn("lineage", F.array_append("lineage", F.col("state_id"))).withColumn("parent_id", F.col("state_id")).withColumn("state_id", new_id)


def transfer(states: DataFrame, target: Column, bandwidth: float, latency: float) -> DataFrame:
    """The state under a new id at its target, with what the move costs."""
    moved = total_bytes(F.col("blocks"))
    out = states.withColumn("transfer_sec", moved / F.lit(max(bandwidth, 1e-12)) + F.lit(latency)).withColumn("moved_bytes", moved)
    out = out.withColumn("lineage", F.array_append("lineage", F.col("state_id"))).withColumn("source_node", F.col("owner_node")).withColumn("owner_node", target)
    return out.withColumn("state_id", F.substring(F.sha2(F.concat_ws("/", "state_id", "owner_node"), 256), 1, 12))


def compatible(groups: DataFrame, by: str) -> DataFrame:
    """Raises for a merge whose states differ in an identity field."""
    same = F.count_distinct(F.struct(*[F.coalesce(F.col(c), F.lit("")) for c in IDENTITY])) == 1
    checked = groups.groupBy(by).agg(F.when(same, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("states of merge "), F.col(by).cast("string"), F.lit(" are not compatible")))).alias("_ok"))
    return groups.join(checked, by).where("_ok").drop("_ok")


def merge(states: DataFrame, by: str, order: str, policy: str) -> DataFrame:
    """One row for each merge: 'prefix_compatible', 'segment_concat' or 'summary_reduce'."""
    rows = compatible(states, by).withColumn("_span", span(F.col("blocks"))).withColumn("_n", total_bytes(F.col("blocks")))
    ids = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("state_id").alias("s")))), lambda x: x["s"])
    if policy == "prefix_compatible":
        equal = F.count_distinct("_span") == 1
        return rows.groupBy(by).agg(ids.alias("state_ids"), F.when(equal, F.min_by("blocks", order)).otherwise(F.raise_error(F.lit("spans differ"))).alias("blocks"))
    if policy == "segment_concat":
        parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("blocks").alias("b"))))
        return rows.groupBy(by).agg(ids.alias("state_ids"), F.flatten(F.transform(parts, lambda x: x["b"])).alias("blocks"))
    if policy == "summary_reduce":
        return rows.groupBy(by).agg(ids.alias("state_ids"), F.sum("_n").alias("nbytes"), F.min("_span.start").alias("token_start"), F.max("_span.end").alias("token_end"))
    raise ValueError(f"no merge policy {policy}")


def token_limited(blocks: DataFrame, by: str, order: str, limit: int) -> DataFrame:
    """The blocks (by, order, tokens) that fit a token budget, the last one cut; kept tokens in `kept`."""
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = F.least(F.col("tokens"), F.greatest(F.lit(0), F.lit(limit) - before))
    return blocks.withColumn("kept", kept).where("kept > 0")


def evict(states: DataFrame, when: Column, reason: str) -> DataFrame:
    """Adds status and reason; live views filter on the status."""
    return states.withColumn("status", F.when(when, "evicted").otherwise("live")).withColumn("reason", F.when(when, F.lit(reason)))


def send(states: DataFrame, path: str) -> None:
    """Writes states as JSON, a folder for each node that they go to."""
    states.withColumn("to_node", F.col("owner_node")).write.mode("append").partitionBy("to_node").json(path)


def receive(spark: SparkSession, path: str, asked: DataFrame, schema: StructType) -> DataFrame:
    """The sent states that are asked for by state_id; one that was never sent is an error."""
    sent = spark.read.schema(schema).json(path).withColumn("_sent", F.lit(True))
    lost = F.raise_error(F.concat(F.lit("state "), F.col("state_id"), F.lit(" has not been sent")))
    return asked.join(sent, "state_id", "left").where(F.coalesce(F.col("_sent"), lost.cast("boolean"))).drop("_sent", "to_node")
