"""Queries over conversations: recent turns, buffers, memory reads and writes, contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import hashed_unit_rows
from ..operators import memory as M
from ..operators.nearness import near_earlier
from ..operators.retrieval import ranked
from ..registry import query, table
from .retrieval import cosine_sql, hashed_sql, top_sql


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


@query("SELECT conv_id, turn, role, text, rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM conversations) WHERE rank <= 4")
def stm_last4(spark, sf_dir):
    return M.recent(turns(spark, sf_dir), "conv_id", "turn", 4).select("conv_id", "turn", "role", "text", "rank")


@query("SELECT conv_id, turn, array_to_string(list(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), ',') AS held FROM conversations")
def stm_window20(spark, sf_dir):
    return M.buffers(turns(spark, sf_dir), "conv_id", "turn", 20).select("conv_id", "turn", F.array_join(F.col("buffer").cast("array<string>"), ",").alias("held"))


@query("SELECT role, conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id DESC, turn DESC) AS r FROM conversations) WHERE r <= 200")
def memory_fifo(spark, sf_dir):
    """The newest 200 entries of each role: what a first-in first-out store of that size holds."""
    rows = turns(spark, sf_dir).withColumn("seq", F.struct("conv_id", "turn"))
    return M.recent(rows, "role", "seq", 200).select("role", "conv_id", "turn")


@query("SELECT conv_id, count(*) AS turns, max(turn) AS last_turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END)::BIGINT AS asked FROM conversations GROUP BY conv_id")
def turn_counts(spark, sf_dir):
    return turns(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("turn").alias("last_turn"), F.count_if(F.col("role") == "user").alias("asked"))


LAST = "SELECT conv_id AS qid, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id"
ALL = "SELECT conv_id * 1000 + turn AS id, text FROM conversations"
LTM = f"SELECT a.qid, a.id, a.score FROM (SELECT qid, id, sum(a.value * b.value) AS score FROM ({hashed_sql(ALL, 'id')}) a JOIN ({hashed_sql(LAST, 'qid')}) b ON a.slot = b.slot AND a.id // 1000 = b.qid GROUP BY qid, id) a"


def _ltm(spark, sf_dir):
    rows = turns(spark, sf_dir)
    own = hashed_unit_rows(rows.select("conv_id", "turn", "text"), ["conv_id", "turn"], "text")
    last = rows.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    asked = hashed_unit_rows(last, ["conv_id"], "text").withColumnRenamed("value", "asked")
    scores = own.join(asked, ["conv_id", "slot"]).groupBy(F.col("conv_id").alias("qid"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id")).agg(F.sum(F.col("value") * F.col("asked")).alias("score"))
    return ranked(scores, 4)


@query(top_sql(LTM, 4))
def ltm_topk(spark, sf_dir):
    """Of each conversation, the four turns closest to its last question."""
    return _ltm(spark, sf_dir).select("qid", "id", "rank", "score")


@query()
def memory_gate(spark, sf_dir):
    return M.store(turns(spark, sf_dir))


@query(f"""SELECT conv_id, coalesce(stm, '') AS stm, coalesce(ltm, '') AS ltm, 'Recent: ' || coalesce(stm, '') || ' | Related: ' || coalesce(ltm, '') AS context FROM (SELECT DISTINCT conv_id FROM conversations)
LEFT JOIN (SELECT conv_id, string_agg(role || '#' || turn, ' ' ORDER BY turn) AS stm FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM conversations) WHERE rank <= 4 GROUP BY conv_id) USING (conv_id)
LEFT JOIN (SELECT qid AS conv_id, string_agg(id::VARCHAR, ' ' ORDER BY rank) AS ltm FROM ({top_sql(LTM, 4)}) GROUP BY qid) USING (conv_id)""")
def context_load(spark, sf_dir):
    rows = turns(spark, sf_dir)
    short = M.recent(rows, "conv_id", "turn", 4).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws("#", "role", "turn").alias("t")))).alias("s"))
    short = short.select("conv_id", F.array_join(F.transform("s", lambda x: x["t"]), " ").alias("stm"))
    near = _ltm(spark, sf_dir).groupBy(F.col("qid").alias("conv_id")).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("t")))).alias("s"))
    near = near.select("conv_id", F.array_join(F.transform("s", lambda x: x["t"]), " ").alias("ltm"))
    out = rows.select("conv_id").distinct().join(short, "conv_id", "left").join(near, "conv_id", "left").fillna("", ["stm", "ltm"])
    return out.withColumn("context", F.concat(F.lit("Recent: "), "stm", F.lit(" | Related: "), "ltm"))


OLD = "SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE role = 'assistant'"
DISTINCT = f"SELECT min(id) AS id, text FROM ({OLD}) GROUP BY text"


@query(f"SELECT o.id FROM ({OLD}) o JOIN (SELECT min(id) AS first, text FROM ({OLD}) GROUP BY text) f USING (text) WHERE o.id = f.first AND o.id NOT IN (SELECT b.id FROM ({cosine_sql(DISTINCT, DISTINCT.replace('min(id) AS id', 'min(id) AS qid'))}) p JOIN ({DISTINCT}) b ON b.id = greatest(p.id, p.qid) WHERE p.id <> p.qid AND round(p.score, 6) >= 0.99)")
def near_dup_anti(spark, sf_dir):
    """Assistant turns that no earlier one resembles: an anti join on similarity over all turns."""
    rows = turns(spark, sf_dir).where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return rows.select("id").join(near_earlier(rows, 0.99), "id", "left_anti")


@query("""SELECT c.conv_id, c.turn, 'System: answer from the context.' || chr(10) || 'Question: ' || q.text || chr(10) || 'Answer:' AS prompt,
least(80, greatest(24, len(list_filter(string_split(replace(c.text, chr(10), ' '), ' '), lambda x: x <> '')) + len(list_filter(string_split(replace(q.text, chr(10), ' '), ' '), lambda x: x <> '')) // 2)) AS tokens
FROM conversations c JOIN conversations q ON q.conv_id = c.conv_id AND q.turn = c.turn - 1 WHERE c.role = 'assistant' AND q.role = 'user'""")
def prompt_and_tokens(spark, sf_dir):
    """Prompts, and how many tokens the mock model bills for the answer that followed."""
    from ..functions.text import blank_words

    rows = turns(spark, sf_dir)
    q = rows.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("asked"))
    both = rows.where("role = 'assistant'").join(q, ["conv_id", "turn"])
    billed = F.size(blank_words(F.col("text"))) + F.floor(F.size(blank_words(F.col("asked"))) / 2)
    prompt = F.concat_ws("\n", F.lit("System: answer from the context."), F.concat(F.lit("Question: "), "asked"), F.lit("Answer:"))
    return both.select("conv_id", "turn", prompt.alias("prompt"), F.least(F.lit(80), F.greatest(F.lit(24), billed)).alias("tokens"))


@query("SELECT conv_id, turn, trim(repeat(substr(md5(text), 1, 16) || ' ', greatest(1, length(text) // 40 // 2)::INT)) AS answer FROM conversations WHERE role = 'user'")
def hash_answers(spark, sf_dir):
    """The deterministic stand-in for a generator: a digest, repeated by the length asked for."""
    rows = turns(spark, sf_dir).where("role = 'user'")
    times = F.greatest(F.lit(1), F.floor(F.floor(F.length("text") / 40) / 2)).cast("int")
    return rows.select("conv_id", "turn", F.trim(F.repeat(F.concat(F.substring(F.md5("text"), 1, 16), F.lit(" ")), times)).alias("answer"))


FOLLOW = "SELECT c.conv_id * 1000 + c.turn AS qid, c.text AS follow, f.text || chr(10) || 'Follow-up: ' || c.text AS aware FROM conversations c JOIN conversations f ON f.conv_id = c.conv_id AND f.turn = c.turn - 2 WHERE c.role = 'user' AND f.role = 'user'"


@query(FOLLOW)
def followup_rewrite(spark, sf_dir):
    rows = turns(spark, sf_dir).where("role = 'user'")
    first = rows.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("text").alias("seed"))
    both = rows.join(first, ["conv_id", "turn"])
    return both.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("text").alias("follow"), F.concat("seed", F.lit("\nFollow-up: "), "text").alias("aware"))
