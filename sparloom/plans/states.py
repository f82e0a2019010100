"""Queries over key-value states, one a conversation: bytes, forks, transfers, merges, budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import blank_words
from ..operators import states as S
from ..registry import query, table

WORDS = "len(list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> ''))"
STATES = f"SELECT 'conv-' || conv_id AS state_id, conv_id, sum({WORDS})::BIGINT AS tokens, CASE WHEN conv_id % 2 = 0 THEN 'a' ELSE 'b' END AS owner FROM conversations GROUP BY conv_id"
LAYERS, HEADS, HIDDEN = 2, 4, 16
PER_TOKEN = LAYERS * HIDDEN * 2 * 2


def states(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.size(blank_words(F.col("text")))).alias("token_count"))
    rows = rows.select("conv_id", F.concat(F.lit("conv-"), "conv_id").alias("state_id"), "token_count", F.when(F.col("conv_id") % 2 == 0, "a").otherwise("b").alias("owner_node"), F.array(F.lit("root")).alias("lineage"), *[F.lit("m").alias(c) for c in S.IDENTITY])
    return S.materialize(rows, LAYERS, HEADS, HIDDEN)


@query(f"SELECT state_id, {LAYERS} AS blocks, tokens * {PER_TOKEN} AS nbytes, 0 AS token_start, tokens AS token_end FROM ({STATES})")
def kv_bytes(spark, sf_dir):
    span = S.span(F.col("blocks"))
    return states(spark, sf_dir).select("state_id", F.size("blocks").alias("blocks"), S.total_bytes(F.col("blocks")).alias("nbytes"), span["start"].alias("token_start"), span["end"].alias("token_end"))


@query(f"SELECT substr(sha256(state_id || '/' || b), 1, 12) AS state_id, state_id AS parent_id, b AS branch_index, 'root,' || state_id AS lineage, tokens * {PER_TOKEN} AS nbytes FROM ({STATES}), (SELECT unnest(range(3)) AS b)")
def kv_fork(spark, sf_dir):
    out = S.fork(states(spark, sf_dir), 3)
    return out.select("state_id", "parent_id", "branch_index", F.array_join("lineage", ",").alias("lineage"), S.total_bytes(F.col("blocks")).alias("nbytes"))


@query(f"SELECT substr(sha256(state_id || '/c'), 1, 12) AS state_id, owner AS source_node, 'c' AS owner_node, tokens * {PER_TOKEN} AS moved_bytes, round(tokens * {PER_TOKEN} / 1e6 + 0.0125, 9) AS transfer_sec, 'root,' || state_id AS lineage FROM ({STATES})")
def kv_transfer(spark, sf_dir):
    out = S.transfer(states(spark, sf_dir), F.lit("c"), 1e6, 0.0125)
    return out.select("state_id", "source_node", "owner_node", "moved_bytes", F.round("transfer_sec", 9).alias("transfer_sec"), F.array_join("lineage", ",").alias("lineage"))


#: Conversations of one workflow, whose states are merged: a bounded group.
FLOW = 8
MERGES = f"SELECT conv_id // {FLOW} AS merge_id, * FROM ({STATES})"


def merges(spark, sf_dir):
    return states(spark, sf_dir).withColumn("merge_id", F.floor(F.col("conv_id") / FLOW))


@query(f"SELECT merge_id, string_agg(state_id, ',' ORDER BY conv_id) AS state_ids, count(*) * {LAYERS} AS blocks, sum(tokens)::BIGINT * {PER_TOKEN} AS nbytes FROM ({MERGES}) GROUP BY merge_id")
def kv_merge_concat(spark, sf_dir):
    out = S.merge(merges(spark, sf_dir), "merge_id", "conv_id", "segment_concat")
    return out.select("merge_id", F.array_join("state_ids", ",").alias("state_ids"), F.size("blocks").alias("blocks"), S.total_bytes(F.col("blocks")).alias("nbytes"))


@query(f"SELECT merge_id, string_agg(state_id, ',' ORDER BY conv_id) AS state_ids, sum(tokens)::BIGINT * {PER_TOKEN} AS nbytes, 0 AS token_start, max(tokens) AS token_end FROM ({MERGES}) GROUP BY merge_id")
def kv_merge_summary(spark, sf_dir):
    out = S.merge(merges(spark, sf_dir), "merge_id", "conv_id", "summary_reduce")
    return out.select("merge_id", F.array_join("state_ids", ",").alias("state_ids"), "nbytes", "token_start", "token_end")


@query(f"SELECT state_id AS merge_id, string_agg(substr(sha256(state_id || '/' || b), 1, 12), ',' ORDER BY b) AS state_ids, {LAYERS} AS blocks, any_value(tokens) AS token_end FROM ({STATES}), (SELECT unnest(range(3)) AS b) GROUP BY state_id")
def kv_merge_prefix(spark, sf_dir):
    """Forks of one state share its span and merge back to its blocks."""
    out = S.merge(S.fork(states(spark, sf_dir), 3), "parent_id", "branch_index", "prefix_compatible")
    return out.select(F.col("parent_id").alias("merge_id"), F.array_join("state_ids", ",").alias("state_ids"), F.size("blocks").alias("blocks"), S.span(F.col("blocks"))["end"].alias("token_end"))


@query(f"SELECT conv_id, turn, tokens, least(tokens, greatest(0, 40 - prev))::BIGINT AS kept FROM (SELECT conv_id, turn, {WORDS} AS tokens, coalesce(sum({WORDS}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM conversations) WHERE least(tokens, greatest(0, 40 - prev)) > 0")
def kv_token_limit(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(blank_words(F.col("text"))).cast("long").alias("tokens"))
    return S.token_limited(rows, "conv_id", "turn", 40)


@query(f"SELECT owner, sum(CASE WHEN tokens <= 200 THEN tokens * {PER_TOKEN} ELSE 0 END)::BIGINT AS live_bytes, count(*) FILTER (WHERE tokens > 200) AS evicted FROM ({STATES}) GROUP BY owner")
def kv_live(spark, sf_dir):
    out = S.evict(states(spark, sf_dir), F.col("token_count") > 200, "capacity")
    n = S.total_bytes(F.col("blocks"))
    return out.groupBy(F.col("owner_node").alias("owner")).agg(F.sum(F.when(F.col("status") != "evicted", n).otherwise(0)).alias("live_bytes"), F.count_if(F.col("status") == "evicted").alias("evicted"))
