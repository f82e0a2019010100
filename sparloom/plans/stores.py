"""Queries over stored indexes, keyed stores, and the streams that feed them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators import vector_index
from ..registry import query, table
from ..session import kept, shared_folder
from ..sources.store import KeyedStore
from ..streaming import coalesce
from ..streaming.cache import Cache
from .retrieval import ITEMS, _vector_sql, chunk_index, chunks, hashed_sql, items
from .runs import RUNS_OF


def _root(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _indexed(spark, sf_dir, metric):
    rows = table(spark, sf_dir, "embeddings")
    path = vector_index.stored(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))
    return vector_index.search(spark, path, rows.where("vec_id % 50 = 0"), 10, metric).select("qid", "id", "rank", "score")


@query(_vector_sql("list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"))
def indexed_topk_ip(spark, sf_dir):
    """As dense_topk_ip, from an index that is built once and skips cells."""
    return _indexed(spark, sf_dir, "ip")


@query(_vector_sql("-list_sum(list_transform(range(1, 65), lambda i: (q.embedding[i]::DOUBLE - v.embedding[i]::DOUBLE) * (q.embedding[i]::DOUBLE - v.embedding[i]::DOUBLE))) + 0.0"))
def indexed_topk_l2(spark, sf_dir):
    return _indexed(spark, sf_dir, "l2")


@query("SELECT user_id, event_id, event_type, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def keyed_upsert(spark, sf_dir):
    """Events by the third of the time in which they fell, upserted into a store of buckets one third after the other."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", F.col("ts").cast("timestamp").cast("double").alias("at"))
    low, high = rows.agg(F.min("at"), F.max("at")).first()
    third = F.coalesce(F.least(F.lit(2), F.floor((F.col("at") - F.lit(low)) / F.lit(max((high or 0) - (low or 0), 1e-9)) * 3)), F.lit(2))
    store = KeyedStore(spark, _root(spark, "upserts"), "user_id", "event_id", 16)
    for i in range(3):
        store.upsert(rows.where(third == i).drop("at"))
    return store.read(rows.drop("at").schema).withColumn("value", F.round("value", 6))


# ------------------------------------------------------------------- coalescing

TARGET, PATIENCE, PIECES = 16, 3_600_000, 2
EVENTS = f'SELECT user_id % 4 AS shard, user_id // 4 % {PIECES} AS piece, event_id AS id, epoch_us(ts::TIMESTAMP) // 1000 AS "at" FROM events'


@query(f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY shard, piece ORDER BY "at", id) AS r FROM ({EVENTS})),
f AS (SELECT shard, piece, r, id, "at", 0::BIGINT AS flush, "at" AS since, 1 AS held FROM e WHERE r = 1
UNION ALL SELECT e.shard, e.piece, e.r, e.id, e."at", f.flush + CASE WHEN f.held = {TARGET} OR e."at" - f.since >= {PATIENCE} THEN 1 ELSE 0 END,
  CASE WHEN f.held = {TARGET} OR e."at" - f.since >= {PATIENCE} THEN e."at" ELSE f.since END, CASE WHEN f.held = {TARGET} OR e."at" - f.since >= {PATIENCE} THEN 1 ELSE f.held + 1 END
  FROM f JOIN e ON e.shard = f.shard AND e.piece = f.piece AND e.r = f.r + 1)
SELECT shard::INT AS shard, piece::INT AS piece, flush, CASE WHEN count(*) = {TARGET} THEN 'full' ELSE 'late' END AS cause, count(*) AS size, min("at") AS first_at, max("at") AS last_at, min(id) AS least_id, sum(id)::BIGINT AS ids FROM f GROUP BY 1, 2, 3""")
def stream_coalesce(spark, sf_dir):
    """Events arrive in four slices of time, each at least one micro-batch; a last row far ahead in time ends the patience of what waits."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 4).cast("int").alias("shard"), (F.floor(F.col("user_id") / 4) % PIECES).cast("int").alias("piece"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    root = _root(spark, "coalesce")
    low, high = (t.timestamp() if t else 0.0 for t in rows.agg(F.min("ts"), F.max("ts")).first())
    rows.limit(0).write.parquet(f"{root}/rows/slice=-1")
    flushes = coalesce.coalesced(spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{root}/rows"), TARGET, PATIENCE)
    slices = F.least(F.lit(3), F.floor((F.col("ts").cast("double") - low) / max(high - low, 1e-9) * 4))
    last = spark.range(1).select(F.lit(-1).alias("shard"), F.lit(0).alias("piece"), F.lit(-1).cast("long").alias("id"), F.timestamp_seconds(F.lit(high + 10 * PATIENCE / 1000)).alias("ts"))
    for i, part in enumerate([*(rows.where(slices == s) for s in range(4)), last]):
        part.write.parquet(f"{root}/rows/slice={i}")
        coalesce.run(flushes, root)
    done = spark.read.schema(coalesce.FLUSHED).option("recursiveFileLookup", True).parquet(f"{root}/flushes").where("shard >= 0")
    return done.groupBy("shard", "piece", "flush", "cause").agg(F.count("*").alias("size"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.min("id").alias("least_id"), F.sum("id").alias("ids"))


# --------------------------------------------------------------- semantic cache

STAGES = 8
QUESTIONS = f"""SELECT conv_id * 1000 + turn AS qid, turn AS "at", coalesce(text, '') AS text, least(turn // 2, {STAGES - 1}) AS b FROM conversations WHERE role = 'user'"""


def _served(asked: str, vectors: str, stages: int) -> str:
    """CTEs v1..vN (verdicts) and e0..eN (entries) of questions asked(qid, "at", text, b): each stage reads before it puts."""
    out = [f"q AS MATERIALIZED ({asked})", f"v AS MATERIALIZED ({vectors})",
           "near AS MATERIALIZED (SELECT * FROM (SELECT a.qid, e.qid AS seq, round(sum(a.value * e.value), 6) AS score FROM v a JOIN v e USING (slot) JOIN q x ON x.qid = a.qid JOIN q y ON y.qid = e.qid WHERE y.b < x.b GROUP BY 1, 2) WHERE score >= 0.92)",
           'e0 AS (SELECT qid, "at", text FROM q WHERE FALSE)']
    for i in range(stages):
        out.append(f"""w{i} AS MATERIALIZED (SELECT q.qid, q."at", q.text, CASE WHEN x.seq IS NOT NULL THEN 'exact' WHEN n.seq IS NOT NULL THEN 'near' ELSE 'miss' END AS kind, coalesce(x.seq, n.seq) AS seq, CASE WHEN x.seq IS NOT NULL THEN 1.0 ELSE n.score END AS score
FROM q LEFT JOIN (SELECT text, arg_max(qid, "at" * 1000000000 + qid) AS seq FROM e{i} GROUP BY text) x ON x.text = q.text
LEFT JOIN (SELECT qid, score, seq FROM (SELECT near.*, row_number() OVER (PARTITION BY near.qid ORDER BY score DESC, seq) AS r FROM near JOIN e{i} ON e{i}.qid = seq) WHERE r = 1) n ON n.qid = q.qid WHERE q.b = {i})""")
        out.append(f"""e{i + 1} AS MATERIALIZED (SELECT * FROM e{i} UNION ALL SELECT qid, "at", text FROM w{i} WHERE kind = 'miss')""")
    return ", ".join(out)


def _all_stages(stages: int) -> str:
    return " UNION ALL ".join(f"SELECT * FROM w{i}" for i in range(stages))


@query(f"""WITH {_served(QUESTIONS, hashed_sql(f'SELECT qid, text FROM ({QUESTIONS})', 'qid'), STAGES)} SELECT w.qid, w."at", kind, w.seq, w.score, substr(md5(coalesce(e.text, w.text)), 1, 16) AS answer FROM ({_all_stages(STAGES)}) w LEFT JOIN q e ON e.qid = w.seq""")
def cache_stream(spark, sf_dir):
    """User turns in order of their numbers, a few numbers a micro-batch, through the cache as a stateful stream."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("turn").alias("at"), "text")
    stage = F.least(F.floor(F.col("at") / 2), F.lit(STAGES - 1))
    cache = Cache(spark, _root(spark, "cache"))
    for number in sorted(r[0] for r in rows.select(stage).distinct().collect()):  # STAGES at most
        cache.arrive(rows.where(stage == number), number)
        cache.serve()
    return cache.verdicts().select("qid", "at", "kind", "seq", F.when(F.col("kind") != "miss", F.col("score")).alias("score"), "answer")


TWICE = """SELECT item_id * 2 AS qid, 0 AS "at", text, 0 AS b FROM benchmark UNION ALL SELECT item_id * 2 + 1, 1, CASE WHEN item_id % 2 = 0 THEN text ELSE array_to_string(list_reverse(string_split(text, ' ')), ' ') END, 1 FROM benchmark"""


@query(f"""WITH {_served(TWICE, hashed_sql(f'SELECT qid, text FROM ({TWICE})', 'qid'), 2)}, runs AS (SELECT qid * 2 AS qid, 'Answer from context: ' || substr(context, 1, 240) AS answer FROM ({RUNS_OF}))
SELECT w.qid, kind, w.seq, md5(coalesce(r.answer, 'Answer from context: ')) AS answer_md5 FROM ({_all_stages(2)}) w LEFT JOIN runs r ON r.qid = CASE WHEN kind = 'miss' THEN w.qid ELSE w.seq END""")
def engine_stream(spark, sf_dir):
    """Questions answered through the cache: what misses is answered from its three best chunks and put; all are asked twice, every second one in other words' order."""
    asked = items(spark, sf_dir)
    again = F.when(F.col("qid") % 2 == 0, F.col("text")).otherwise(F.array_join(F.reverse(F.split("text", " ")), " "))
    held, index = chunks(spark, sf_dir), chunk_index(spark, sf_dir)

    def answer(missed):
        hits = kept(R.hybrid_topk(index, missed.select("qid", "text"), 3), "hits")  # small, so that chunks are not shuffled to meet them
        found = hits.join(held, "id").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("h"))
        context = F.array_join(F.transform("h", lambda x: F.concat(F.lit("[Doc "), x["rank"].cast("string"), F.lit("] "), x["text"])), "\n\n")
        told = missed.select("qid").join(found.select("qid", context.alias("context")), "qid", "left")
        return told.select("qid", F.concat(F.lit("Answer from context: "), F.substring(F.coalesce("context", F.lit("")), 1, 240)).alias("answer"))

    cache = Cache(spark, _root(spark, "engine"), answer=answer)
    for number, text in enumerate((F.col("text"), again)):
        cache.arrive(asked.select((F.col("qid") * 2 + number).alias("qid"), F.lit(number).cast("long").alias("at"), text.alias("text")), number)
        cache.serve()
    return cache.verdicts().select("qid", "kind", "seq", F.md5("answer").alias("answer_md5"))
