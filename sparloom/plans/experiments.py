"""Queries over result rows, run files, carried states and operator specs."""

from __future__ import annotations

import uuid

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..operators import graphs as G
from ..operators import results as X
from ..operators import states as K
from ..registry import query, table
from ..session import shared_folder
from .costs import GRID, workload_grid
from .states import PER_TOKEN, STATES, states

r6 = lambda c: F.round(c, 6)

BACKENDS, WORKLOADS, CONTEXTS = ["hf-local", "VLLM", "sglang_http", "Other"], ["stateful", "dense_prefill", "text_passing", ""], [128, 512, 2048]
#: Events as result rows with the gaps that such rows have: blank, unreadable and missing cells, flags as text.
ROWS = f"""SELECT event_id AS row_id, event_type AS baseline_name, 'm' || (user_id % 3) AS model_id, {BACKENDS}[event_id % 4 + 1] AS backend, {WORKLOADS}[(event_id // 4) % 4 + 1] AS workload_name,
{CONTEXTS}[user_id % 3 + 1] AS context_tokens, user_id % 2 + 1 AS num_agents, user_id % 4 + 1 AS branch_factor, user_id % 50 + 1 AS num_requests,
CASE event_id % 5 WHEN 0 THEN 'false' WHEN 1 THEN NULL ELSE 'True' END AS available, CASE WHEN event_id % 7 = 0 THEN 'true' ELSE '' END AS skipped,
CASE event_id % 11 WHEN 0 THEN '' WHEN 1 THEN 'nan' WHEN 2 THEN NULL ELSE value::VARCHAR END AS ttft_sec, CASE WHEN event_id % 13 = 0 THEN (value * 2)::VARCHAR END AS prefill_sec,
CASE event_id % 3 WHEN 0 THEN (value / 20 - 0.5)::VARCHAR WHEN 1 THEN '' END AS exact_match_rate, CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN '' END AS exact_match,
CASE event_id % 3 WHEN 0 THEN 'length;token' WHEN 1 THEN event_type ELSE '' END AS causes FROM events"""
NUMBER = "CASE WHEN isfinite(TRY_CAST({0} AS DOUBLE)) THEN TRY_CAST({0} AS DOUBLE) END"
TTFT, PREFILL, RATE = NUMBER.format("ttft_sec"), NUMBER.format("prefill_sec"), NUMBER.format("exact_match_rate")
USABLE = "(available IS NULL OR lower(available) = 'true') AND skipped <> 'true'"
FAMILY = "CASE WHEN lower(backend) LIKE 'hf%' THEN 'hf' WHEN lower(backend) LIKE 'vllm%' THEN 'vllm' WHEN lower(backend) LIKE 'sglang%' THEN 'sglang' ELSE lower(backend) END"


def result_rows(spark, sf_dir):
    e, u, text = F.col("event_id"), F.col("user_id"), F.col("value").cast("string")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        e.alias("row_id"),
        F.col("event_type").alias("baseline_name"),
        F.concat(F.lit("m"), (u % 3).cast("string")).alias("model_id"),
        pick(BACKENDS, e % 4).alias("backend"),
        pick(WORKLOADS, F.floor(e / 4) % 4).alias("workload_name"),
        pick(CONTEXTS, u % 3).alias("context_tokens"),
        (u % 2 + 1).alias("num_agents"),
        (u % 4 + 1).alias("branch_factor"),
        (u % 50 + 1).alias("num_requests"),
        F.when(e % 5 == 0, "false").when(e % 5 != 1, "True").alias("available"),
        F.when(e % 7 == 0, "true").otherwise("").alias("skipped"),
        F.when(e % 11 == 0, "").when(e % 11 == 1, "nan").when(e % 11 != 2, text).alias("ttft_sec"),
        F.when(e % 13 == 0, (F.col("value") * 2).cast("string")).alias("prefill_sec"),
        F.when(e % 3 == 0, (F.col("value") / 20 - 0.5).cast("string")).when(e % 3 == 1, "").alias("exact_match_rate"),
        F.when(e % 4 == 0, "true").when(e % 4 == 1, "false").when(e % 4 == 2, "").alias("exact_match"),
        F.when(e % 3 == 0, "length;token").when(e % 3 == 1, F.col("event_type")).otherwise("").alias("causes"),
    )


@query(f"""SELECT row_id, {USABLE} AS usable, round({TTFT}, 9) AS ttft, {FAMILY} AS family, round(CASE WHEN {RATE} IS NOT NULL THEN greatest(0, least(1, {RATE})) WHEN exact_match <> '' THEN (exact_match = 'true')::INT END, 9) AS agreement,
{USABLE} AND {TTFT} IS NOT NULL AND (workload_name IN ('stateful', '') OR lower(backend) = 'vllm') AS primary_row FROM ({ROWS})""")
def result_predicates(spark, sf_dir):
    """Each result row's flags and numbers: usable, finite figure, family, clamped agreement, whether it is a primary row."""
    ok, ttft = X.usable(F.col("available"), F.col("skipped")), X.number(F.col("ttft_sec"))
    first = ok & ttft.isNotNull() & (F.col("workload_name").isin("stateful", "") | (F.lower("backend") == "vllm"))
    rate = X.agreement([F.col("exact_match_rate")], F.col("exact_match"))
    return result_rows(spark, sf_dir).select("row_id", ok.alias("usable"), F.round(ttft, 9).alias("ttft"), X.family(F.col("backend")).alias("family"), F.round(rate, 9).alias("agreement"), first.alias("primary_row"))


AVAILABLE = "lower(available) = 'true'"


@query(f"SELECT model_id, {FAMILY} AS backend, workload_name, count(*) AS n, count(*) FILTER (WHERE {AVAILABLE}) AS available_rows, count(*) FILTER (WHERE skipped = 'true') AS skipped_rows, round(coalesce(avg({TTFT}) FILTER (WHERE {AVAILABLE}), 0), 6) AS mean_ttft_sec, round(coalesce(avg({PREFILL}) FILTER (WHERE {AVAILABLE}), 0), 6) AS mean_prefill_sec FROM ({ROWS}) GROUP BY 1, 2, 3")
def matrix_summary(spark, sf_dir):
    """Rows of a model, family and workload: how many, available, skipped, and means over the available."""
    there = X.truthy(F.col("available"))
    mean = lambda c: r6(X.mean_or_zero(F.when(there, F.col(c))))
    rows = result_rows(spark, sf_dir).withColumn("backend", X.family(F.col("backend")))
    return rows.groupBy("model_id", "backend", "workload_name").agg(F.count("*").alias("n"), F.count_if(there).alias("available_rows"), F.count_if(X.truthy(F.col("skipped"))).alias("skipped_rows"), mean("ttft_sec").alias("mean_ttft_sec"), mean("prefill_sec").alias("mean_prefill_sec"))


@query(f"""WITH good AS (SELECT *, coalesce({PREFILL}, {TTFT}) AS took FROM ({ROWS}) WHERE {USABLE})
SELECT s.row_id, s.model_id, s.context_tokens, round(d.took / s.took, 6) AS speedup FROM good s JOIN (SELECT * FROM good WHERE workload_name = 'dense_prefill' QUALIFY row_number() OVER (PARTITION BY model_id, backend, context_tokens, num_agents, branch_factor ORDER BY row_id DESC) = 1) d
USING (model_id, backend, context_tokens, num_agents, branch_factor) WHERE s.workload_name = 'stateful' AND s.took > 0 AND d.took IS NOT NULL""")
def speedup_points(spark, sf_dir):
    """Stateful rows against the last dense row of the same model, backend and shape."""
    return X.speedups(result_rows(spark, sf_dir), "dense_prefill", "stateful").select("row_id", "model_id", "context_tokens", r6("speedup").alias("speedup"))


@query(f"""WITH good AS (SELECT *, {TTFT} AS t, {FAMILY} AS family FROM ({ROWS}) WHERE {USABLE} AND {TTFT} > 0)
SELECT s.row_id, s.baseline_name AS label, s.num_agents::DOUBLE AS x, round(s.t / d.t, 6) AS ratio FROM good s JOIN (SELECT * FROM good WHERE baseline_name = 'purchase' QUALIFY row_number() OVER (PARTITION BY model_id, family, context_tokens, branch_factor, num_agents ORDER BY row_id DESC) = 1) d USING (model_id, family, context_tokens, branch_factor, num_agents)""")
def speedup_by_agents(spark, sf_dir):
    """Each baseline's time over the reference's at the same number of agents."""
    return X.speedups_at(result_rows(spark, sf_dir), "num_agents", "ttft_sec", "purchase").withColumn("ratio", r6("ratio"))


KEYS = ["workload_name", "context_tokens", "num_agents", "branch_factor", "num_requests"]


@query(f"""WITH r AS (SELECT *, {TTFT} AS t FROM ({ROWS})), f AS (SELECT * FROM r WHERE baseline_name = 'purchase' AND t > 0),
near AS (SELECT {', '.join(KEYS)}, min_by(t, row_id) AS near FROM f GROUP BY ALL), far AS (SELECT workload_name, min_by(t, row_id) AS far FROM f GROUP BY 1)
SELECT row_id, round(coalesce(near, far), 9) AS ref_ttft, CASE WHEN t > 0 AND skipped <> 'true' AND coalesce(near, far) IS NOT NULL THEN round(t / coalesce(near, far), 6) ELSE 0 END AS speedup FROM r LEFT JOIN near USING ({', '.join(KEYS)}) LEFT JOIN far USING (workload_name)""")
def reference_table(spark, sf_dir):
    """Each row beside the first reference row of its five keys, else of its workload."""
    out = X.beside_reference(result_rows(spark, sf_dir), F.col("baseline_name") == "purchase", KEYS, "workload_name")
    return out.select("row_id", F.round("ref_ttft", 9).alias("ref_ttft"), r6("speedup").alias("speedup"))


@query(f"""WITH r AS (SELECT * FROM ({ROWS})) SELECT * FROM (SELECT model_id, count(*) AS prompts, count(*) FILTER (WHERE {AVAILABLE}) AS available_prompts, count(*) FILTER (WHERE skipped = 'true') AS skipped_prompts, count(*) FILTER (WHERE {AVAILABLE} AND exact_match = 'true') AS exact_matches,
round(coalesce(avg(coalesce({RATE}, 0)) FILTER (WHERE {AVAILABLE}), 0), 6) AS mean_match, string_agg(DISTINCT CASE WHEN skipped = 'true' THEN baseline_name END, ';' ORDER BY CASE WHEN skipped = 'true' THEN baseline_name END) AS skip_reasons FROM r GROUP BY 1)
JOIN (SELECT model_id, string_agg(DISTINCT c, ';' ORDER BY c) AS mismatch_causes FROM (SELECT model_id, unnest(string_split(causes, ';')) AS c FROM r) WHERE c <> '' GROUP BY 1) USING (model_id)""")
def consistency_full(spark, sf_dir):
    """Prompts of a model: counts, exact matches, mean rate, distinct causes and reasons for skips."""
    there, gone = X.truthy(F.col("available")), X.truthy(F.col("skipped"))
    rate = F.coalesce(X.number(F.col("exact_match_rate")), F.lit(0.0))
    said = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ";")  # noqa: E731  labels, a few by nature
    rows = result_rows(spark, sf_dir)
    counts = rows.groupBy("model_id").agg(F.count("*").alias("prompts"), F.count_if(there).alias("available_prompts"), F.count_if(gone).alias("skipped_prompts"), F.count_if(there & X.truthy(F.col("exact_match"))).alias("exact_matches"), r6(F.coalesce(F.avg(F.when(there, rate)), F.lit(0.0))).alias("mean_match"), said(F.when(gone, F.col("baseline_name"))).alias("skip_reasons"))
    causes = rows.select("model_id", F.explode(F.split("causes", ";")).alias("c")).where("c <> ''").groupBy("model_id").agg(said(F.col("c")).alias("mismatch_causes"))
    return counts.join(causes, "model_id")


FIELDS = ["ttft_sec", "total_latency_sec", "kv_total_bytes"]


@query("SELECT user_id % 16 AS run, count(*)::DOUBLE AS kv_total_bytes, CASE WHEN user_id % 16 % 4 = 1 THEN round(max(value), 6) END AS ttft_sec, CASE WHEN user_id % 16 % 4 = 0 THEN round(sum(value), 4) END AS total_latency_sec FROM events WHERE user_id % 16 % 4 < 2 GROUP BY user_id % 16")
def run_files(spark, sf_dir):
    """Run files written in several shapes (wrapped, flat, gathered, broken) below one folder, scanned and reduced to rows of known fields."""
    runs = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 16).alias("run")).agg(F.count("*").alias("kv_total_bytes"), F.round(F.sum("value"), 4).alias("total_latency_sec"), r6(F.max("value")).alias("ttft_sec"))
    shape = F.col("run") % 4
    wrapped = F.to_json(F.struct(F.struct("kv_total_bytes", "total_latency_sec", F.lit("x").alias("note")).alias("metrics")))
    body = F.when(shape == 0, wrapped).when(shape == 1, F.to_json(F.struct("kv_total_bytes", "ttft_sec"))).when(shape == 2, F.lit('{"runs": [{"ttft_sec": 1}]}')).otherwise(F.lit('{"ttft_sec": '))
    path = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    runs.select("run", body.alias("value")).repartition("run").write.partitionBy("run").text(path)
    return X.run_rows(spark, path, FIELDS).select(F.regexp_extract("file", r"run=(\d+)", 1).cast("long").alias("run"), *FIELDS)


@query(f"SELECT owner AS source_node, count(*) AS transfers, (sum(tokens) * {PER_TOKEN})::BIGINT AS bytes, round(sum(tokens * {PER_TOKEN} / 1e7 + 1e-3), 6) AS seconds FROM ({STATES}) GROUP BY 1")
def transfer_totals(spark, sf_dir):
    """States sent as files to another node and received there by their ids; totals by sender."""
    moved = K.transfer(states(spark, sf_dir), F.lit("c"), 1e7, 1e-3)
    path = f"{shared_folder(spark)}/states-{uuid.uuid4().hex}"
    K.send(moved, path)
    got = K.receive(spark, path, moved.select("state_id"), moved.schema)
    return got.groupBy("source_node").agg(F.count("*").alias("transfers"), F.sum("moved_bytes").alias("bytes"), r6(F.sum("transfer_sec")).alias("seconds"))


@query("""WITH w AS (SELECT unnest([1, 2, 4]) AS n), s AS (SELECT n, 'materialize_prefix' AS name, 'materialize' AS kind, 0 AS place, 0 AS inputs FROM w UNION ALL SELECT n, 'fork_' || i, 'fork', i + 1, 1 FROM (SELECT n, unnest(range(n)) AS i FROM w)
UNION ALL SELECT n, 'merge_branches', 'restricted_merge', n + 1, n FROM w UNION ALL SELECT n, 'generate_answer', 'generate', n + 2, 1 FROM w) SELECT 'branches_' || n AS graph, name AS node_id, kind, place::INT AS place, inputs::INT AS inputs FROM s""")
def spec_order(spark, sf_dir):
    """Operator specs of a branching workload, told last first, in an order that respects what they depend on."""
    told = {}
    for n in (1, 2, 4):
        forks = [f"fork_{i}" for i in range(n)]
        nodes = [("materialize_prefix", "materialize", 0), *[(f, "fork", 1) for f in forks], ("merge_branches", "restricted_merge", n), ("generate_answer", "generate", 1)]
        edges = [*[("materialize_prefix", f) for f in forks], *[(f, "merge_branches") for f in forks], ("merge_branches", "generate_answer")]
        told[f"branches_{n}"] = (nodes, edges)
    nodes = spark.createDataFrame([(g, x, k, i, p) for g, (ns, _) in told.items() for p, (x, k, i) in enumerate(ns)], "graph string, node_id string, kind string, inputs int, pos int").orderBy(F.desc("pos"))
    edges = spark.createDataFrame([(g, a, b) for g, (_, es) in told.items() for a, b in es], "graph string, source string, target string")
    return X.in_order(nodes, G.levels(nodes, edges)).select("graph", "node_id", "kind", F.col("place").cast("int").alias("place"), "inputs")


#: Words of a serving prompt, taken in turn; fixed values.
SERVING = ["stateful", "agentic", "algebra", "benchmark", "prefix", "cache", "serving", "latency"]


@query(f"SELECT conv_id, n AS input_len, array_to_string(list_transform(range(greatest(1, greatest(1, n) // 2)), lambda i: {SERVING}[i % 8 + 1]), ' ') AS prompt FROM (SELECT conv_id, context_tokens AS n FROM ({GRID}))")
def serving_prompts(spark, sf_dir):
    """Prompts that stay below a conversation's number of tokens: half as many words, at least one."""
    lengths = workload_grid(spark, sf_dir).select("conv_id", F.col("context_tokens").alias("input_len"))
    words = F.greatest(F.lit(1), F.expr("greatest(1, input_len) div 2"))
    vocabulary = F.array(*map(F.lit, SERVING))
    return lengths.select("conv_id", "input_len", F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), words), lambda i: F.element_at(vocabulary, (F.pmod(i - 1, F.lit(8)) + 1).cast("int"))), " ").alias("prompt"))


@query(f"SELECT conv_id, context_tokens, output_tokens, num_agents, branch_factor, round(context_tokens * 2e-4, 9) AS ttft_sec, round(context_tokens * 2e-4, 9) AS prefill_sec, round(output_tokens * 5e-5, 9) AS decode_sec, round(context_tokens * 2e-4 + output_tokens * 5e-5, 9) AS total_latency_sec, (context_tokens * {PER_TOKEN})::BIGINT AS kv_total_bytes, 'estimate: no model measured' AS reason FROM ({GRID})")
def estimated_measurements(spark, sf_dir):
    """What a measurement would say, from token counts alone, where no model can be run; marked with its reason."""
    prefill, decode = F.col("context_tokens") * 2e-4, F.col("output_tokens") * 5e-5
    nine = lambda c, name: F.round(c, 9).alias(name)
    return workload_grid(spark, sf_dir).select("*", nine(prefill, "ttft_sec"), nine(prefill, "prefill_sec"), nine(decode, "decode_sec"), nine(prefill + decode, "total_latency_sec"), (F.col("context_tokens") * PER_TOKEN).cast("long").alias("kv_total_bytes"), F.lit("estimate: no model measured").alias("reason"))


@query("SELECT doc_id, 'chars=' || length(coalesce(text, '')) || ',file=' || coalesce(source, '') || ',kind=text' AS metadata FROM documents")
def metadata_put(spark, sf_dir):
    """Metadata of documents with entries put over those that they had."""
    had = F.create_map(F.lit("file"), F.coalesce("source", F.lit("")), F.lit("kind"), F.lit("raw"))
    new = F.create_map(F.lit("kind"), F.lit("text"), F.lit("chars"), F.length(F.coalesce("text", F.lit(""))).cast("string"))
    merged = F.transform(F.array_sort(F.map_entries(X.put(had, new))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(merged, ",").alias("metadata"))


@query("SELECT count(*) AS vectors, sum(len(embedding))::BIGINT AS numbers FROM embeddings")
def counting_sink(spark, sf_dir):
    """A sink that stores nothing and tells what passed."""
    seen = Observation()
    table(spark, sf_dir, "embeddings").observe(seen, F.count(F.lit(1)).alias("vectors"), F.sum(F.size("embedding")).alias("numbers")).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["vectors"], seen.get["numbers"])], "vectors long, numbers long")
