"""Queries over runs: full summaries, combined requests, logs, cases and answers, ingestion."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import vectors as V
from ..operators import retrieval as R
from ..operators import standing
from ..registry import query, table
from ..session import kept, shared_folder
from ..sources import runs as S
from ..sources.sharding import SEGMENT_BYTES, spread
from .retrieval import CHUNKS, HYBRID, ITEMS, chunk_index, chunks, items, top_sql
from .texts import CLEAN, cleaned

r6 = lambda c: F.round(c, 6)

# ---------------------------------------------------------------- run metrics

NAMES = ["ttft", "kv-materialize", "generate", "kv_transfer", "kv.resume", "framework_overhead", "kv_fork", "kv_merge", "kv_evict", "recompute", "kv_reuse", "latency"]
#: Normalized event names, and the total that they add to or the counter that they raise; fixed values.
DURATION = {"ttft": "ttft_sec", "time_to_first_token": "ttft_sec", "total_latency": "total_latency_sec", "latency": "total_latency_sec", "run": "total_latency_sec", "request": "total_latency_sec", "prefill": "prefill_sec", "materialize": "prefill_sec", "kv_materialize": "prefill_sec", "recompute": "prefill_sec", "decode": "decode_sec", "generate": "decode_sec", "llm_generate": "decode_sec", "transfer": "transfer_sec", "kv_transfer": "transfer_sec", "resume": "resume_sec", "kv_resume": "resume_sec", "omega": "omega_sec", "framework_overhead": "omega_sec"}
LIFECYCLE = {"transfer": "transfer_count", "kv_transfer": "transfer_count", "materialize": "materialize_count", "kv_materialize": "materialize_count", "fork": "fork_count", "kv_fork": "fork_count", "merge": "merge_count", "kv_merge": "merge_count", "restricted_merge": "merge_count", "evict": "evict_count", "kv_evict": "evict_count"}
EVENTS = f"SELECT user_id AS run, event_id AS seq, replace(replace(lower({NAMES}[event_id % 12 + 1]), '-', '_'), '.', '_') AS name, value AS sec, floor(value * 100)::BIGINT AS bytes, event_type AS said, (event_id % 7)::BIGINT AS tokens FROM events"


def _events(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("event_id") % 12 + 1).cast("int"))
    normal = F.replace(F.replace(F.lower(name), F.lit("-"), F.lit("_")), F.lit("."), F.lit("_"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), normal.alias("name"), F.col("value").alias("sec"), F.floor(F.col("value") * 100).cast("long").alias("bytes"), F.col("event_type").alias("said"), (F.col("event_id") % 7).cast("long").alias("tokens"))


PARTS = {"prefill_sec": "'kv_materialize', 'recompute'", "decode_sec": "'generate'", "transfer_sec": "'kv_transfer'", "resume_sec": "'kv_resume'", "omega_sec": "'framework_overhead'"}


@query("SELECT run, ttft_sec, round(total, 4) AS total_latency_sec, round(prefill_sec, 4) AS prefill_sec, round(decode_sec, 4) AS decode_sec, round(transfer_sec, 4) AS transfer_sec, round(resume_sec, 4) AS resume_sec, round(omega_sec, 4) AS omega_sec, CASE WHEN total > 0 THEN round(output_tokens / total, 6) ELSE 0 END AS throughput_tokens_per_sec, kv_total_bytes, kv_total_bytes AS kv_peak_bytes, kv_transferred_bytes, round(reuses / greatest(1, reuses + materialize_count), 6) AS kv_reuse_ratio, transfer_count, materialize_count, fork_count, merge_count, evict_count, num_agents, output_tokens, 'synthetic' AS baseline_name, agreement AS output_agreement_rate FROM (SELECT *, CASE WHEN said_total > 0 THEN said_total ELSE prefill_sec + decode_sec + transfer_sec + resume_sec + omega_sec END AS total FROM (SELECT run, coalesce(round(max(sec) FILTER (WHERE name = 'ttft'), 6), 0) AS ttft_sec, coalesce(sum(sec) FILTER (WHERE name = 'latency'), 0) AS said_total, " + ", ".join(f"coalesce(sum(sec) FILTER (WHERE name IN ({v})), 0) AS {k}" for k, v in PARTS.items()) + ", coalesce(sum(bytes) FILTER (WHERE name = 'kv_materialize'), 0)::BIGINT AS kv_total_bytes, coalesce(sum(bytes) FILTER (WHERE name = 'kv_transfer'), 0)::BIGINT AS kv_transferred_bytes, count(*) FILTER (WHERE name = 'kv_reuse') AS reuses, " + ", ".join(f"count(*) FILTER (WHERE name = 'kv_{k}') AS {k}_count" for k in ("transfer", "materialize", "fork", "merge", "evict")) + f", max_by(tokens, seq) FILTER (WHERE name = 'kv_fork') AS num_agents, sum(tokens)::BIGINT AS output_tokens FROM ({EVENTS}) GROUP BY run) LEFT JOIN (SELECT run, CASE WHEN sum(n) >= 2 THEN round(max(n) / sum(n), 6) END AS agreement FROM (SELECT run, said, count(*) AS n FROM ({EVENTS}) WHERE name = 'generate' GROUP BY 1, 2) GROUP BY run) USING (run))")
def run_summary_full(spark, sf_dir):
    """A run's events as one row of all its figures; num_agents is said by the last fork, explicit values win over sums."""
    rows = _events(spark, sf_dir)
    of = lambda target, book: F.col("name").isin(*[n for n, t in book.items() if t == target])
    total = lambda target, column="sec": F.coalesce(F.sum(F.when(of(target, DURATION), F.col(column))), F.lit(0.0))
    sums = [total(t).alias(t) for t in ("prefill_sec", "decode_sec", "transfer_sec", "resume_sec", "omega_sec")]
    counts = [F.count_if(of(t, LIFECYCLE)).alias(t) for t in ("transfer_count", "materialize_count", "fork_count", "merge_count", "evict_count")]
    byte = lambda n: F.coalesce(F.sum(F.when(F.col("name") == n, F.col("bytes"))), F.lit(0))
    said = F.max_by(F.when(F.col("name") == "kv_fork", F.col("tokens")), F.when(F.col("name") == "kv_fork", F.col("seq")))
    ttft = F.coalesce(r6(F.max(F.when(of("ttft_sec", DURATION), F.col("sec")))), F.lit(0.0))
    out = rows.groupBy("run").agg(ttft.alias("ttft_sec"), total("total_latency_sec").alias("said_total"), *sums, byte("kv_materialize").alias("kv_total_bytes"), byte("kv_transfer").alias("kv_transferred_bytes"), F.count_if(F.col("name").contains("reuse")).alias("reuses"), *counts, said.alias("num_agents"), F.sum("tokens").alias("output_tokens"))
    per = rows.where("name = 'generate'").groupBy("run", F.lower(F.trim("said")).alias("t")).agg(F.count("*").alias("n"))
    per = per.groupBy("run").agg(F.when(F.sum("n") >= 2, r6(F.max("n") / F.sum("n"))).alias("output_agreement_rate"))
    parts = F.col("prefill_sec") + F.col("decode_sec") + F.col("transfer_sec") + F.col("resume_sec") + F.col("omega_sec")
    out = out.join(per, "run", "left").withColumn("total", F.when(F.col("said_total") > 0, F.col("said_total")).otherwise(parts))
    return out.select("run", "ttft_sec", F.round("total", 4).alias("total_latency_sec"), *[F.round(c, 4).alias(c) for c in PARTS], F.when(F.col("total") > 0, r6(F.col("output_tokens") / F.col("total"))).otherwise(0.0).alias("throughput_tokens_per_sec"), "kv_total_bytes", F.col("kv_total_bytes").alias("kv_peak_bytes"), "kv_transferred_bytes", r6(F.col("reuses") / F.greatest(F.lit(1), F.col("reuses") + F.col("materialize_count"))).alias("kv_reuse_ratio"), "transfer_count", "materialize_count", "fork_count", "merge_count", "evict_count", "num_agents", "output_tokens", F.lit("synthetic").alias("baseline_name"), "output_agreement_rate")


@query(f"SELECT run % 16 AS workload, round(sum(sec), 4) AS total_latency_sec, sum(bytes)::BIGINT AS kv_transferred_bytes, round(avg(sec) FILTER (WHERE name = 'ttft'), 6) AS ttft_sec, max(bytes) AS kv_peak_bytes, sum(tokens)::BIGINT AS output_tokens, CASE WHEN sum(sec) > 0 AND sum(tokens) > 0 THEN round(sum(tokens) / sum(sec), 6) END AS throughput_tokens_per_sec, round(sum(sec) * 4, 4) AS scaled_latency_sec, sum(bytes)::BIGINT * 4 AS scaled_bytes FROM ({EVENTS}) GROUP BY 1")
def combine_requests(spark, sf_dir):
    """Requests of one workload as one row: sums, means over what is there, maxima; and the same scaled to four times as many."""
    seconds, tokens = F.sum("sec"), F.sum("tokens")
    rate = F.when((seconds > 0) & (tokens > 0), r6(tokens / seconds))
    return _events(spark, sf_dir).groupBy((F.col("run") % 16).alias("workload")).agg(F.round(seconds, 4).alias("total_latency_sec"), F.sum("bytes").alias("kv_transferred_bytes"), r6(F.avg(F.when(F.col("name") == "ttft", F.col("sec")))).alias("ttft_sec"), F.max("bytes").alias("kv_peak_bytes"), tokens.alias("output_tokens"), rate.alias("throughput_tokens_per_sec"), F.round(seconds * 4, 4).alias("scaled_latency_sec"), (F.sum("bytes") * 4).alias("scaled_bytes"))


@query("""WITH r AS (SELECT user_id AS run, count(*)::DOUBLE AS n, round(avg(value), 3) AS ttft, round(max(value), 3) AS itl, round(sum(value), 3) AS rate FROM events GROUP BY 1)
SELECT run, metric, round(value, 9) AS value FROM (SELECT run, unnest([{m: 'successful_requests', v: n}, {m: 'mean_ttft_ms', v: ttft}, {m: 'mean_ttft_sec', v: ttft / 1000}, {m: 'ttft_sec', v: ttft / 1000}, {m: 'p50_itl_ms', v: itl}, {m: 'p50_itl_sec', v: itl / 1000}, {m: 'itl_sec', v: itl / 1000}, {m: 'output_token_throughput_tok_s', v: rate}, {m: 'throughput_tokens_per_sec', v: rate}]) AS x FROM r), LATERAL (SELECT x.m AS metric, x.v AS value)""")
def serving_log(spark, sf_dir):
    """Every run's events told as a serving log, with noise, and read again: every label, milliseconds as seconds, aliases."""
    r3 = lambda c: F.round(c, 3).cast("string")
    runs = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run")).agg(F.count("*").alias("n"), r3(F.avg("value")).alias("ttft"), r3(F.max("value")).alias("itl"), r3(F.sum("value")).alias("rate"))
    said = F.array(F.concat(F.lit("Successful requests: "), "n"), F.concat(F.lit("Mean time to first token (ms):   "), "ttft"), F.concat(F.lit("P50 ITL (ms): "), "itl"), F.lit("noise"), F.lit("broken: x1"), F.concat(F.lit("Output token throughput (tok/s): "), "rate"))
    lines = runs.select("run", F.posexplode(said).alias("at", "value"))
    return S.log_metrics(lines, ["run"]).withColumn("value", F.round("value", 9))


@query("""SELECT run, CASE run % 3 WHEN 2 THEN 0 ELSE n END AS count, round(CASE run % 3 WHEN 2 THEN CASE WHEN coalesce(list_sort(xs)[len(xs) // 2 + 1], 0) > 10 THEN list_sum(xs) / 1000 ELSE coalesce(list_sum(xs), 0) END ELSE total END, 6) AS seconds
FROM (SELECT user_id AS run, count(*) AS n, round(sum(value), 3) AS total, coalesce(list(value) FILTER (WHERE value >= 0), []) AS xs FROM events GROUP BY 1)""")
def metric_entries(spark, sf_dir):
    """Runs' metrics as JSON under various names, or as bare samples, each as one count and its seconds."""
    runs = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("t"), F.collect_list("value").alias("xs"))
    entry = lambda **cells: F.to_json(F.struct(*[F.col(c).alias(k) for k, c in cells.items()]))
    body = F.when(F.col("run") % 3 == 0, entry(count="n", total_sec="t")).when(F.col("run") % 3 == 1, entry(n="n", sum_s="t")).otherwise(entry(samples="xs"))
    return runs.select("run", S.metric_entry(body).alias("e")).select("run", "e.count", F.round("e.seconds", 6).alias("seconds"))


RUN_COUNTS = "SELECT user_id AS run, ['preprocess.clean', 'preprocess.chunk_per_chunk', 'preprocess.load', 'vectorstore.add'][event_id % 4 + 1] AS metric, count(*) AS n, sum(value) AS sec FROM events GROUP BY 1, 2"


@query(f"SELECT run, coalesce(nullif(coalesce(max(n) FILTER (WHERE metric = 'preprocess.clean'), 0), 0), max(n) FILTER (WHERE metric = 'preprocess.load'), 0) AS docs, coalesce(nullif(coalesce(max(n) FILTER (WHERE metric = 'preprocess.chunk_per_chunk'), 0), 0), max(n) FILTER (WHERE metric = 'vectorstore.add'), 0) AS chunks, round(max(sec), 4) AS runtime_s, CASE WHEN max(sec) > 0 THEN round(coalesce(nullif(coalesce(max(n) FILTER (WHERE metric = 'preprocess.clean'), 0), 0), max(n) FILTER (WHERE metric = 'preprocess.load'), 0) / max(sec), 6) ELSE 0 END AS docs_per_s FROM ({RUN_COUNTS}) GROUP BY run")
def run_rates(spark, sf_dir):
    """Documents and chunks of a run by the first metric that counts them, its longest stage, and the rate."""
    name = F.element_at(F.array(*map(F.lit, ["preprocess.clean", "preprocess.chunk_per_chunk", "preprocess.load", "vectorstore.add"])), (F.col("event_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run"), name.alias("metric")).agg(F.count("*").alias("n"), F.sum("value").alias("sec"))
    of = lambda m: F.max(F.when(F.col("metric") == m, F.col("n")))
    pick = lambda a, b: F.coalesce(F.nullif(F.coalesce(of(a), F.lit(0)), F.lit(0)), of(b), F.lit(0))
    docs = pick("preprocess.clean", "preprocess.load")
    return rows.groupBy("run").agg(docs.alias("docs"), pick("preprocess.chunk_per_chunk", "vectorstore.add").alias("chunks"), F.round(F.max("sec"), 4).alias("runtime_s"), F.when(F.max("sec") > 0, r6(docs / F.max("sec"))).otherwise(0.0).alias("docs_per_s"))


@query("SELECT event_id, CASE WHEN lower(trim(event_type)) = 'view' THEN 'dense_prefill' WHEN lower(trim(event_type)) = 'click' THEN 'kvcomm_prefix' ELSE lower(trim(event_type)) END AS baseline, regexp_replace(props, '[^A-Za-z0-9._-]', '_', 'g') AS safe_name, substr(sha256(props), 1, 16) AS fingerprint, printf('%06d_%s_%d', event_id, event_type, user_id) AS run_id, greatest(0, least(1, coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE value / 50 END, CASE WHEN event_type = 'view' THEN 1.0 ELSE 0 END))) AS consistency, epoch_us(ts)::DOUBLE / 1e6 AS epoch_sec FROM events")
def row_labels(spark, sf_dir):
    """Canonical names, safe file names, fingerprints, run ids, clamped first-of values and epoch seconds."""
    low = F.lower(F.trim("event_type"))
    alias = F.coalesce(F.try_element_at(F.create_map(F.lit("view"), F.lit("dense_prefill"), F.lit("click"), F.lit("kvcomm_prefix")), low), low)
    rate = F.coalesce(F.when(F.col("event_id") % 3 != 0, F.col("value") / 50), (F.col("event_type") == "view").cast("double"))
    return table(spark, sf_dir, "events").select("event_id", alias.alias("baseline"), F.regexp_replace("props", "[^A-Za-z0-9._-]", "_").alias("safe_name"), F.substring(F.sha2("props", 256), 1, 16).alias("fingerprint"), F.format_string("%06d_%s_%d", "event_id", "event_type", "user_id").alias("run_id"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), rate)).alias("consistency"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("epoch_sec"))


@query("SELECT baseline, value, extra FROM (SELECT event_type AS baseline, round(sum(value), 4) AS value, NULL::BIGINT AS extra FROM events GROUP BY 1 UNION ALL SELECT 'users', round(count(DISTINCT user_id), 4), count(*) FROM events)")
def result_sinks(spark, sf_dir):
    """Result rows with different fields written as one CSV with a tail of columns, and read back."""
    rows = table(spark, sf_dir, "events")
    both = rows.groupBy(F.col("event_type").alias("baseline")).agg(F.round(F.sum("value"), 4).alias("value")).unionByName(rows.agg(F.lit("users").alias("baseline"), F.count_distinct("user_id").cast("double").alias("value"), F.count("*").alias("extra")), allowMissingColumns=True)
    path = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    S.write_results(both, path, ["baseline", "value"])
    return S.read_results(spark, path).select("baseline", F.col("value").cast("double"), F.col("extra").cast("long"))


@query("SELECT count(*) AS runs, sum(t)::BIGINT AS tokens, round(sum(value), 4) AS seconds, round(avg(value), 6) AS avg_sec, CASE WHEN sum(value) > 0 THEN round(sum(t) / sum(value), 6) END AS tokens_per_s FROM (SELECT value, event_id % 50 AS t FROM events WHERE event_type = 'view')")
def generation_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type = 'view'").withColumn("t", F.col("event_id") % 50)
    return rows.agg(F.count("*").alias("runs"), F.sum("t").alias("tokens"), F.round(F.sum("value"), 4).alias("seconds"), r6(F.avg("value")).alias("avg_sec"), F.when(F.sum("value") > 0, r6(F.sum("t") / F.sum("value"))).alias("tokens_per_s"))


# ------------------------------------------------------- cases, answers, conversations

#: First 24 words or more, two keywords or more; the first case of each source and pair of keywords.
CASES = f"""SELECT doc_id, source, k1, k2, preview FROM (SELECT *, row_number() OVER (PARTITION BY source, k1, k2 ORDER BY doc_id) AS r FROM (SELECT doc_id, source, list_extract(keys, 1) AS k1, list_extract(keys, 2) AS k2, array_to_string(w[1:18], ' ') AS preview FROM
(SELECT doc_id, source, string_split({CLEAN}, ' ') AS w FROM documents) JOIN (SELECT doc_id, list(tok ORDER BY rank) AS keys FROM (KEYWORDS) GROUP BY doc_id) USING (doc_id) WHERE len(w) >= 24 AND len(keys) >= 2)) WHERE r = 1"""


def _case_sql() -> str:
    from ..registry import SQL

    return CASES.replace("KEYWORDS", SQL["keywords"])


def _cases(spark, sf_dir):
    words = F.split(T.clean(T.first_words(F.col("text"), 24)), " ")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.when(F.size(words) >= 24, F.array_join(F.slice(words, 1, 18), " ")).alias("preview")).where("preview is not null")
    ranked = T.keywords(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], "text").where("rank <= 2")
    keys = ranked.groupBy("doc_id").agg(F.max(F.when(F.col("rank") == 1, F.col("tok"))).alias("k1"), F.max(F.when(F.col("rank") == 2, F.col("tok"))).alias("k2")).where("k2 is not null")
    first = docs.join(keys, "doc_id").groupBy("source", "k1", "k2").agg(F.min(F.struct("doc_id", "preview")).alias("f"))
    return first.select("f.doc_id", "source", "k1", "k2", "f.preview")


@query(_case_sql())
def retrieval_cases(spark, sf_dir):
    return _cases(spark, sf_dir)


FOLLOW_UP = "What else does it say about this topic? Answer the follow-up using the same subject as the previous turn."
TWO = f"SELECT doc_id * 2 AS qid, doc_id, 'plain' AS engine, '{FOLLOW_UP}' AS text FROM (CASES) UNION ALL SELECT doc_id * 2 + 1, doc_id, 'aware', 'I am reading a passage about ' || k1 || ' and ' || k2 || '. Use this text as the current topic: ' || preview || chr(10) || 'Follow-up: {FOLLOW_UP}' FROM (CASES)"


def _follow_sql() -> str:
    from .retrieval import bm25_sql, cosine_sql

    two = TWO.replace("(CASES)", f"(SELECT * FROM ({_case_sql()}) WHERE doc_id % 50 = 0)")
    rows = "SELECT doc_id AS id, text FROM documents"
    hybrid = HYBRID.replace(cosine_sql(CHUNKS, ITEMS), cosine_sql(rows, two)).replace(bm25_sql(CHUNKS, ITEMS), bm25_sql(rows, two))
    return f"SELECT engine, count(*) AS cases, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0 END), 6) AS top1, round(avg(CASE WHEN rank IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS hit_at_5, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM ({two}) q LEFT JOIN ({top_sql(hybrid, 5)}) h ON h.qid = q.qid AND h.id = q.doc_id GROUP BY engine"


@query(_follow_sql())
def followup_eval(spark, sf_dir):
    """Every 50th document's case asked twice, with and without the turn before: which finds the document among all."""
    rows = kept(_cases(spark, sf_dir).where("doc_id % 50 = 0"), "cases")  # asked twice
    seed = F.concat(F.lit("I am reading a passage about "), "k1", F.lit(" and "), "k2", F.lit(". Use this text as the current topic: "), "preview")
    asked = rows.select((F.col("doc_id") * 2).alias("qid"), F.col("doc_id").alias("expected"), F.lit("plain").alias("engine"), F.lit(FOLLOW_UP).alias("text"))
    asked = asked.union(rows.select(F.col("doc_id") * 2 + 1, "doc_id", F.lit("aware"), F.concat(seed, F.lit("\nFollow-up: " + FOLLOW_UP))))
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), SEGMENT_BYTES)
    own = table(spark, sf_dir, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("expected"), F.col("text").alias("own"))
    hits = standing.hybrid_rank(docs, asked.join(own, "expected"), 5)
    found = R.rank_metrics(hits, asked.select("qid", "expected"), 5).join(asked.select("qid", "engine"), "qid")
    return found.groupBy("engine").agg(F.count("*").alias("cases"), r6(F.avg("top1")).alias("top1"), r6(F.avg("hit")).alias("hit_at_5"), r6(F.avg("rr")).alias("mrr"))


WORDS_OF = "len(list_filter(string_split(replace({0}, chr(10), ' '), ' '), lambda x: x <> ''))"
RUNS_OF = f"""SELECT q.qid, q.text AS asked, string_agg('[Doc ' || h.rank || '] ' || c.text, chr(10) || chr(10) ORDER BY h.rank) AS context FROM ({ITEMS}) q JOIN ({top_sql(HYBRID, 3)}) h ON h.qid = q.qid JOIN ({CHUNKS}) c ON c.id = h.id GROUP BY 1, 2"""


@query(f"SELECT qid, length(context) AS context_chars, md5(context) AS context_md5, least(80, greatest(24, {WORDS_OF.format('answer')} + {WORDS_OF.format('asked')} // 2)) AS tokens, replace(substr(answer, 1, 120), chr(10), ' ') AS preview FROM (SELECT *, 'Answer from context: ' || substr(context, 1, 240) AS answer FROM ({RUNS_OF}))")
def engine_run(spark, sf_dir):
    """Questions answered from their three best chunks: context, the mock model's billed tokens, and a preview."""
    hits = kept(R.hybrid_topk(chunk_index(spark, sf_dir), items(spark, sf_dir), 3), "hits")  # small, so that chunks are not shuffled to meet them
    joined = hits.join(chunks(spark, sf_dir), "id").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("h"))
    context = F.array_join(F.transform("h", lambda x: F.concat(F.lit("[Doc "), x["rank"].cast("string"), F.lit("] "), x["text"])), "\n\n")
    rows = joined.select("qid", context.alias("context")).join(items(spark, sf_dir), "qid")
    answer = F.concat(F.lit("Answer from context: "), F.substring("context", 1, 240))
    billed = F.size(T.blank_words(answer)) + F.floor(F.size(T.blank_words(F.col("text"))) / 2)
    return rows.select("qid", F.length("context").alias("context_chars"), F.md5("context").alias("context_md5"), F.least(F.lit(80), F.greatest(F.lit(24), billed)).alias("tokens"), F.replace(F.substring(answer, 1, 120), F.lit("\n"), F.lit(" ")).alias("preview"))


# ----------------------------------------------------------------- ingestion and stores

INGEST = f"SELECT doc_id || '-chunk-' || i AS chunk_id, substr(cleaned, i * 800 + 1, 1000) AS chunk FROM (SELECT doc_id, {CLEAN} AS cleaned FROM documents) d, LATERAL (SELECT unnest(range(CASE WHEN length(cleaned) <= 1000 THEN 1 ELSE 1 + ceil((length(cleaned) - 1000) / 800.0)::BIGINT END)) AS i) WHERE cleaned <> ''"
SHARDED = f"SELECT ('0x' || substr(md5(chunk_id), 1, 6))::INT % 4 AS shard, chunk_id, chunk, round(('0x' || substr(sha256(chunk), 1, 2))::INT / 127.5 - 1, 6) AS v0 FROM ({INGEST})"
#: Seconds that a simulated embedder takes for a batch: a part of its own and one for each item; fixed values.
OVERHEAD, PER_ITEM, BATCH = 0.008, 0.0004, 32


def ingested(docs):
    """chunk_id, chunk, embedding and shard of documents (doc_id, cleaned): load, chunk, embed, route by hash."""
    rows = T.chunk_chars(docs, "cleaned").select(F.concat_ws("-chunk-", "doc_id", "chunk_idx").alias("chunk_id"), "chunk")
    shard = F.conv(F.substring(F.md5("chunk_id"), 1, 6), 16, 10).cast("int") % 4
    return rows.select("chunk_id", "chunk", V.byte_embedding(F.col("chunk"), 16).alias("embedding"), shard.alias("shard"))


@query(f"SELECT shard, count(*) AS vectors, round(sum(v0), 4) AS checksum, sum(length(chunk))::BIGINT AS chars, round(ceil(count(*) / {BATCH}.0) * {OVERHEAD} + count(*) * {PER_ITEM}, 6) AS embed_sec FROM ({SHARDED}) GROUP BY shard")
def ingest_batched(spark, sf_dir):
    """Load, chunk, embed and upsert as one plan; a shard's simulated embedding time by batches."""
    rows = ingested(cleaned(spark, sf_dir))
    path = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    rows.write.partitionBy("shard").parquet(path)
    stored = spark.read.schema(rows.schema).parquet(path)
    seconds = F.ceil(F.count("*") / BATCH) * OVERHEAD + F.count("*") * PER_ITEM
    return stored.groupBy("shard").agg(F.count("*").alias("vectors"), F.round(F.sum(F.round(F.col("embedding")[0], 6)), 4).alias("checksum"), F.sum(F.length("chunk")).alias("chars"), r6(seconds).alias("embed_sec"))


@query(f"SELECT shard, count(*) AS vectors, round(sum(v0), 4) AS checksum FROM ({SHARDED}) GROUP BY shard")
def stream_ingest(spark, sf_dir):
    """The same job as a stream of files: each micro-batch is chunked, embedded and appended to its shards."""
    from ..streaming.ingest import ingest

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    docs.write.parquet(f"{root}/files")
    files = max(1, len(spark.read.schema(docs.schema).parquet(f"{root}/files").inputFiles()) // 3)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/files")
    clean = stream.select("doc_id", T.clean(F.col("text")).alias("cleaned")).where("cleaned <> ''")
    stored = ingest(ingested(clean), f"{root}/store", f"{root}/state")
    return stored.groupBy("shard").agg(F.count("*").alias("vectors"), F.round(F.sum(F.round(F.col("embedding")[0], 6)), 4).alias("checksum"))


@query("SELECT h.qid, h.id, h.rank, b.label AS label, h.score FROM (" + top_sql("SELECT q.vec_id AS qid, v.vec_id AS id, list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0", 3) + ") h JOIN embeddings b ON b.vec_id = h.id")
def stored_search(spark, sf_dir):
    """A vector store with metadata written once, read back and searched; hits meet their rows by id."""
    path = f"{shared_folder(spark)}/vectors"
    build = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    path = f"{path}-{uuid.uuid4().hex}"
    build.where(F.assert_true(F.size("embedding") == 64).isNull()).write.mode("ignore").parquet(path)
    store = spark.read.parquet(path)
    hits = R.exact_topk(store, store.where("vec_id % 50 = 0"), 3)
    return hits.join(store.select(F.col("vec_id").alias("id"), "label"), "id").select("qid", "id", "rank", "label", "score")


@query("SELECT label, j, round(sum(x) FILTER (WHERE used) / greatest(count(*) FILTER (WHERE used), 1e-9), 5) AS value, count(*) FILTER (WHERE used) AS used FROM (SELECT label, vec_id % 3 > 0 AS used, unnest(range(64)) AS j, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY label, j")
def masked_mean(spark, sf_dir):
    """Mean pooling of a group's vectors under a mask, component by component."""
    rows = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 3 > 0).alias("mask"), F.posexplode("embedding").alias("j", "x"))
    used = F.count_if("mask")
    return rows.groupBy("label", "j").agg(F.round(F.sum(F.when(F.col("mask"), F.col("x").cast("double"))) / F.greatest(used, F.lit(1e-9)), 5).alias("value"), used.alias("used"))


def blake_rows(rows, text: str = "text", dim: int = 64):
    """Adds blake array<float>: the bytes of the text's 64-byte BLAKE2b digest, tiled to dim, from -1 to 1."""
    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = b"".join(hashlib.blake2b((t or "").encode()).digest() for t in batch.column(text).to_pylist())
            tiled = np.resize(np.frombuffer(digests, np.uint8).reshape(-1, 64).T, (dim, batch.num_rows)).T if batch.num_rows else np.zeros((0, dim))
            flat = pa.array((tiled / 127.5 - 1).astype(np.float32).ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dim), flat)], [*batch.schema.names, "blake"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("blake", ArrayType(FloatType()))]))


@query()
def blake_embed(spark, sf_dir):
    """DuckDB has no BLAKE2b; a test holds it against hashlib."""
    return blake_rows(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "blake")


@query(f"SELECT shard, count(*) AS files, sum(n)::BIGINT AS docs FROM (SELECT source, count(*) AS n, (row_number() OVER (ORDER BY source) - 1) % 3 AS shard FROM documents WHERE source IS NOT NULL GROUP BY source) GROUP BY shard")
def capped_shards(spark, sf_dir):
    """Files in order dealt to ranks, as a launcher's environment names them."""
    rank, world = S.rank_world({"RANK": "4", "WORLD_SIZE": "3"})
    if (rank, world) != (1, 3):
        raise AssertionError("ranks wrap at the world")
    from ..sources.sharding import with_index

    files = with_index(table(spark, sf_dir, "documents").where("source is not null").groupBy("source").agg(F.count("*").alias("n")), ["source"], "i")
    return files.groupBy(F.pmod("i", F.lit(world)).alias("shard")).agg(F.count("*").alias("files"), F.sum("n").alias("docs"))


@query()
def token_edit_distance(spark, sf_dir):
    """Edit distance over tokens of consecutive turns, by characters that stand for a pair's distinct tokens.

    DuckDB's levenshtein counts bytes, so a test holds this against a plain program.
    """
    from ..operators.consistency import token_distance

    rows = table(spark, sf_dir, "conversations")
    both = rows.withColumn("nxt", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("nxt is not null")
    both = both.select("conv_id", "turn", T.tokens(F.col("text")).alias("a"), T.tokens(F.col("nxt")).alias("b")).where(F.size("a") + F.size("b") > 0)
    return both.select("conv_id", "turn", token_distance(F.col("a"), F.col("b")).alias("distance"))
