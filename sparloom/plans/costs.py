"""Queries for the cost model: transfer or recompute, execution baselines, crossovers, grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_words
from ..operators.states import total_bytes
from ..registry import query, table
from .states import PER_TOKEN, STATES, WORDS, states

#: Default costs: seconds a token, an operation, bytes a second; fixed values.
COST = {"bandwidth": 25e9, "latency": 5e-5, "prefill": 2e-4, "decode": 5e-5, "resume": 1e-4, "omega_text": 5e-5, "omega_state": 5e-5, "memory_weight": 0.0}


def decision(owner: Column, target: Column, nbytes: Column, tokens: Column, cost: dict[str, float]) -> Column:
    """struct(decision, time_sec, bytes): reuse where the state is, else the cheaper of moving it and computing anew."""
    decode = 8 * cost["decode"]
    move = nbytes / max(cost["bandwidth"], 1e-12) + cost["latency"]
    keep = move + cost["resume"] + cost["omega_state"] + cost["memory_weight"] * nbytes
    text = tokens * cost["prefill"] + cost["omega_text"]
    say = lambda name, time, size: F.struct(F.lit(name).alias("decision"), time.alias("time_sec"), size.cast("long").alias("bytes"))
    return F.when(owner == target, say("local_reuse", F.lit(cost["resume"] + decode + cost["omega_state"]), nbytes)).when(keep < text, say("transfer", keep + decode, nbytes)).otherwise(say("recompute", text + decode, F.lit(0)))


@query(f"""SELECT state_id, CASE WHEN owner = 'a' THEN 'local_reuse' WHEN keep < text THEN 'transfer' ELSE 'recompute' END AS decision,
round(CASE WHEN owner = 'a' THEN 0.0001 + 8 * 5e-5 + 0.00005 WHEN keep < text THEN keep + 8 * 5e-5 ELSE text + 8 * 5e-5 END, 9) AS time_sec, (CASE WHEN owner = 'a' OR keep < text THEN n ELSE 0 END)::BIGINT AS bytes
FROM (SELECT *, tokens * {PER_TOKEN} AS n, tokens * {PER_TOKEN} / 1e7 + 5e-5 + 0.00015 AS keep, tokens * 3e-5 + 0.00005 AS text FROM ({STATES}))""")
def schedule_decision(spark, sf_dir):
    cost = COST | {"bandwidth": 1e7, "prefill": 3e-5}
    d = decision(F.col("owner_node"), F.lit("a"), total_bytes(F.col("blocks")), F.col("token_count"), cost)
    return states(spark, sf_dir).select("state_id", d.alias("d")).select("state_id", "d.decision", F.round("d.time_sec", 9).alias("time_sec"), "d.bytes")


#: A conversation as a workload: words that agents read and write, roles as agents, answers as branches.
GRID = f"SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN 0 ELSE {WORDS} END)::BIGINT AS context_tokens, greatest(1, sum(CASE WHEN role = 'assistant' THEN {WORDS} ELSE 0 END))::BIGINT AS output_tokens, count(DISTINCT role) AS num_agents, greatest(1, count(*) FILTER (WHERE role = 'assistant')) AS branch_factor FROM conversations GROUP BY conv_id"


def workload_grid(spark, sf_dir):
    n, answer = F.size(blank_words(F.col("text"))), F.col("role") == "assistant"
    written, read = F.sum(F.when(answer, n).otherwise(0)), F.sum(F.when(answer, 0).otherwise(n))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(read.alias("context_tokens"), F.greatest(F.lit(1), written).alias("output_tokens"), F.count_distinct("role").alias("num_agents"), F.greatest(F.lit(1), F.count_if(answer)).alias("branch_factor"))


def baselines(rows: DataFrame, bytes_per_token: int = 512, reuse: float = 0.7, overhead: float = 0.04, cost: dict[str, float] | None = None) -> DataFrame:
    """Each workload under six ways to run it: seconds by part, bytes, reuse, time to the first token."""
    c = cost or COST
    agents, branch = F.col("num_agents"), F.col("branch_factor")
    prefill, decode = F.col("context_tokens") * c["prefill"], F.col("output_tokens") * c["decode"]
    size = F.col("context_tokens") * bytes_per_token
    n = F.greatest(F.lit(1), agents * branch)
    zero = F.lit(0.0)
    share = F.when(agents > 0, (agents - 1) / agents).otherwise(0.0)
    anchor = (n - 1) * prefill * overhead
    ways = {
        "dense_prefill": (agents * prefill, agents * decode, zero, zero, agents * c["omega_text"], agents * size, zero),
        "text_passing": (agents * prefill, agents * decode, zero, zero, agents * c["omega_text"], F.lit(0), zero),
        "vllm_local_prefix": (prefill, agents * decode, zero, agents * c["resume"], agents * c["omega_state"], size, share),
        "sglang_prefix": (prefill, agents * decode, zero, agents * c["resume"], agents * c["omega_state"], size, share),
        "kvcomm_prefix": (prefill + (n - 1) * prefill * (1 - reuse), n * decode, zero, zero, n * c["omega_state"] + anchor, F.floor(size * (1 + (n - 1) * (1 - reuse)) + 1e-6), (n - 1) * reuse / n),
        "distserve_style": (prefill, agents * decode, size / c["bandwidth"] + c["latency"], agents * c["resume"], agents * c["omega_state"], size, share),
    }
    parts = ("prefill_sec", "decode_sec", "transfer_sec", "resume_sec", "omega_sec", "kv_bytes", "reuse_ratio")
    made = [F.struct(F.lit(name).alias("baseline"), *[x.cast("long" if p == "kv_bytes" else "double").alias(p) for p, x in zip(parts, way, strict=True)]) for name, way in ways.items()]
    out = rows.select("*", F.explode(F.array(*made)).alias("b")).select(*rows.columns, "b.*")
    return out.withColumn("total_sec", F.col("prefill_sec") + F.col("decode_sec") + F.col("transfer_sec") + F.col("resume_sec") + F.col("omega_sec"))


def _baseline_sql() -> str:
    p, d, s, n = "context_tokens * 2e-4", "output_tokens * 5e-5", "context_tokens * 512", "greatest(1, num_agents * branch_factor)"
    share = "(num_agents - 1) / num_agents"
    ways = {
        "dense_prefill": (f"num_agents * {p}", f"num_agents * {d}", "0", "0", "num_agents * 0.00005", f"num_agents * {s}", "0"),
        "text_passing": (f"num_agents * {p}", f"num_agents * {d}", "0", "0", "num_agents * 0.00005", "0", "0"),
        "vllm_local_prefix": (p, f"num_agents * {d}", "0", "num_agents * 0.0001", "num_agents * 0.00005", s, share),
        "sglang_prefix": (p, f"num_agents * {d}", "0", "num_agents * 0.0001", "num_agents * 0.00005", s, share),
        "kvcomm_prefix": (f"{p} + ({n} - 1) * {p} * 0.3", f"{n} * {d}", "0", "0", f"{n} * 0.00005 + ({n} - 1) * {p} * 0.04", f"floor({s} * (1 + ({n} - 1) * 0.3) + 1e-6)", f"({n} - 1) * 0.7 / {n}"),
        "distserve_style": (p, f"num_agents * {d}", f"{s} / 25e9 + 5e-5", "num_agents * 0.0001", "num_agents * 0.00005", s, share),
    }
    one = "SELECT conv_id, context_tokens, output_tokens, num_agents, branch_factor, '{0}' AS baseline, round({1}, 9) AS prefill_sec, round({2}, 9) AS decode_sec, round({3}, 9) AS transfer_sec, round({4}, 9) AS resume_sec, round({5}, 9) AS omega_sec, ({6})::BIGINT AS kv_bytes, round({7}, 9) AS reuse_ratio, round({1} + {2} + {3} + {4} + {5}, 9) AS total_sec FROM g"
    return f"WITH g AS ({GRID}) " + " UNION ALL ".join(one.format(name, *way) for name, way in ways.items())


@query(_baseline_sql())
def baseline_rows(spark, sf_dir):
    out = baselines(workload_grid(spark, sf_dir))
    seconds = [c for c in out.columns if c.endswith("_sec") or c == "reuse_ratio"]
    return out.withColumns({c: F.round(c, 9) for c in seconds})


#: Public models: id, layers, hidden size, key-value heads, attention heads, bytes a value, longest context; fixed values.
MODELS = (
    ("distilgpt2", 6, 768, 12, 12, 4, 1024),
    ("gpt2", 12, 768, 12, 12, 4, 1024),
    ("meta-llama/Meta-Llama-3-8B-Instruct", 32, 4096, 8, 32, 2, 8192),
    ("meta-llama/Llama-2-7b-hf", 32, 4096, 32, 32, 2, 4096),
    ("mistralai/Mistral-7B-Instruct-v0.3", 32, 4096, 8, 32, 2, 32768),
    ("Qwen/Qwen2.5-7B-Instruct", 28, 3584, 4, 28, 2, 32768),
    ("Qwen/Qwen2.5-32B-Instruct", 64, 5120, 8, 40, 2, 32768),
)
#: What a model id that is not listed resolves to: the first pattern that its lower-cased form holds, '' any; fixed values.
PATTERNS = (("distilgpt2", 6, 768, 12, 12, 4), ("mistral-7b", 32, 4096, 8, 32, 2), ("qwen2.5-7b", 28, 3584, 4, 28, 2), ("qwen2-7b", 28, 3584, 4, 28, 2), ("qwen2.5-32b", 64, 5120, 8, 40, 2), ("qwen2-32b", 64, 5120, 8, 40, 2), ("llama-3-8b", 32, 4096, 8, 32, 2), ("llama-2-7b", 32, 4096, 32, 32, 2), ("llama-7b", 32, 4096, 32, 32, 2), ("70b", 80, 8192, 8, 64, 2), ("", 32, 4096, 8, 32, 2))
MODEL_SQL = "(VALUES " + ", ".join(str(m) for m in MODELS) + ") AS m(model_id, layers, hidden, kv_heads, heads, dtype_bytes, max_context)"


def models(spark):
    return spark.sql("SELECT * FROM VALUES " + ", ".join(str(m) for m in MODELS) + " AS m(model_id, layers, hidden, kv_heads, heads, dtype_bytes, max_context)")


def model_kv_bytes(tokens: Column) -> Column:
    return (tokens.cast("long") * F.col("layers") * 2 * F.col("kv_heads") * (F.col("hidden") / F.col("heads")).cast("long") * F.col("dtype_bytes")).cast("long")


LINKS = (("1 Gbps", 1e9 / 8), ("10 Gbps", 1e10 / 8), ("100 Gbps", 1e11 / 8))
DELAYS = (("10 us", 1e-5), ("1 ms", 1e-3))


def crossover(spark, contexts: list[int] | DataFrame, links=LINKS, delays=DELAYS) -> DataFrame:
    """Moving a state against computing it again, for each model, context (numbers, or rows with context_tokens), bandwidth and latency."""
    rows = contexts if isinstance(contexts, DataFrame) else spark.createDataFrame([(c,) for c in contexts], "context_tokens long")
    rows = rows.crossJoin(F.broadcast(models(spark)))  # fixed values, like links and delays
    rows = rows.crossJoin(spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{n}', {v}D)" for n, v in links) + " AS t(bandwidth_name, bandwidth)"))
    rows = rows.crossJoin(spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{n}', {v}D)" for n, v in delays) + " AS t(latency_name, latency)"))
    scale = F.col("layers") * F.col("hidden") / (12 * 768)
    recompute = F.greatest(F.lit(1e-6), F.col("context_tokens") * 0.0002 * scale)
    move = F.col("kv_bytes") / F.greatest(F.col("bandwidth"), F.lit(1.0)) + F.col("latency")
    rows = rows.withColumn("kv_bytes", model_kv_bytes(F.col("context_tokens"))).withColumn("recompute_sec", recompute).withColumn("transfer_sec", move)
    return rows.withColumn("benefit", F.col("transfer_sec") < F.col("recompute_sec")).withColumn("speedup", F.when(F.col("transfer_sec") > 0, F.col("recompute_sec") / F.col("transfer_sec")).otherwise(0.0))


@query("SELECT conv_id, model_id, context_tokens, bandwidth_name, latency_name, kv_bytes, round(re, 9) AS recompute_sec, round(mv, 9) AS transfer_sec, mv < re AS benefit, round(re / mv, 6) AS speedup FROM (SELECT *, greatest(1e-6, context_tokens * 0.0002 * (layers * hidden / (12 * 768))) AS re, kv_bytes / bandwidth + latency AS mv FROM (SELECT *, context_tokens::BIGINT * layers * 2 * kv_heads * (hidden // heads) * dtype_bytes AS kv_bytes FROM " + MODEL_SQL + f", (SELECT conv_id, context_tokens FROM ({GRID})), (VALUES " + ", ".join(f"('{n}', {v}::DOUBLE)" for n, v in LINKS) + ") AS b(bandwidth_name, bandwidth), (VALUES " + ", ".join(f"('{n}', {v}::DOUBLE)" for n, v in DELAYS) + ") AS l(latency_name, latency)))")
def crossover_table(spark, sf_dir):
    out = crossover(spark, workload_grid(spark, sf_dir).select("conv_id", "context_tokens"))
    return out.select("conv_id", "model_id", "context_tokens", "bandwidth_name", "latency_name", "kv_bytes", F.round("recompute_sec", 9).alias("recompute_sec"), F.round("transfer_sec", 9).alias("transfer_sec"), "benefit", F.round("speedup", 6).alias("speedup"))


@query("SELECT conv_id, model_id, context_tokens, output_tokens, num_agents, branch_factor, context_tokens + output_tokens > max_context AS skipped, CASE WHEN context_tokens + output_tokens > max_context THEN 'context ' || (context_tokens + output_tokens) || ' exceeds ' || max_context END AS reason FROM " + MODEL_SQL + f", ({GRID})")
def matrix_grid(spark, sf_dir):
    """Every model with every workload; combinations beyond a model's context are marked as skipped."""
    rows = workload_grid(spark, sf_dir).crossJoin(F.broadcast(models(spark)))  # a few fixed models
    asked = F.col("context_tokens") + F.col("output_tokens")
    over = asked > F.col("max_context")
    return rows.select("conv_id", "model_id", "context_tokens", "output_tokens", "num_agents", "branch_factor", over.alias("skipped"), F.when(over, F.concat(F.lit("context "), asked.cast("string"), F.lit(" exceeds "), F.col("max_context").cast("string"))).alias("reason"))


@query("SELECT conv_id, baseline, round(CASE WHEN baseline = 'stateful' THEN kv * (1 + (greatest(1, num_agents * branch_factor) - 1) * 0.15) WHEN baseline IN ('dense_prefill', 'text_passing', 'distserve_style') THEN kv * greatest(1, num_agents * branch_factor) ELSE kv * num_agents * (1 + (branch_factor - 1) * 0.15) END, 6) AS effective_bytes FROM (SELECT unnest(['stateful', 'dense_prefill', 'text_passing', 'distserve_style', 'vllm_local_prefix', 'sglang_prefix', 'kvcomm_prefix']) AS baseline), (SELECT *, context_tokens * 512 AS kv FROM (" + GRID + "))")
def effective_memory(spark, sf_dir):
    """Peak bytes under each baseline's way of sharing."""
    ways = ("stateful", "dense_prefill", "text_passing", "distserve_style", "vllm_local_prefix", "sglang_prefix", "kvcomm_prefix")
    rows = workload_grid(spark, sf_dir).withColumn("baseline", F.explode(F.array(*map(F.lit, ways))))
    kv, n, b = F.col("context_tokens") * 512, F.greatest(F.lit(1), F.col("num_agents") * F.col("branch_factor")), F.col("baseline")
    size = F.when(b == "stateful", kv * (1 + (n - 1) * 0.15)).when(b.isin("dense_prefill", "text_passing", "distserve_style"), kv * n).otherwise(kv * F.col("num_agents") * (1 + (F.col("branch_factor") - 1) * 0.15))
    return rows.select("conv_id", "baseline", F.round(size, 6).alias("effective_bytes"))


@query(f"SELECT conv_id, workers, coalesce(max_by(batch, least_workers) FILTER (WHERE workers >= least_workers), 32) AS batch FROM (SELECT conv_id, output_tokens AS workers FROM ({GRID})), (VALUES (8, 64), (64, 128), (512, 256)) AS t(least_workers, batch) GROUP BY conv_id, workers")
def tier_choice(spark, sf_dir):
    """The batch size of the highest tier that a count of workers reaches; a conversation asks for one a written word."""
    rows = workload_grid(spark, sf_dir).select("conv_id", F.col("output_tokens").alias("workers"))
    tier = F.lit(32)
    for least, batch in ((8, 64), (64, 128), (512, 256)):
        tier = F.when(F.col("workers") >= least, batch).otherwise(tier)
    return rows.withColumn("batch", tier)


def stateful_path(rows: DataFrame, requests: int, shared: float = 0.85, bytes_per_token: int = 512, cost: dict[str, float] | None = None) -> DataFrame:
    """The stateful engine's critical path, request by request: the first pays in full, later ones their suffix."""
    c = cost or COST
    r = rows.withColumn("request", F.explode(F.sequence(F.lit(0), F.lit(requests - 1))))
    first, branches = F.col("request") == 0, F.greatest(F.lit(1), F.col("num_agents") * F.col("branch_factor"))
    suffix = 1 - shared
    size = F.col("context_tokens") * bytes_per_token
    tokens = F.when(first, F.col("context_tokens")).otherwise(F.greatest(F.lit(1), F.floor(F.col("context_tokens") * suffix + 1e-9)))
    moved = F.when(first, size).otherwise(F.floor(size * suffix + 1e-9))
    transfer = F.when(branches > 1, moved / c["bandwidth"] + c["latency"]).otherwise(0.0)
    parts = {"prefill_sec": tokens * c["prefill"], "transfer_sec": transfer, "resume_sec": F.when(first, c["resume"]).otherwise(c["resume"] / 2), "decode_sec": F.col("output_tokens") * c["decode"], "omega_sec": c["omega_state"] * (2 + F.least(branches, F.lit(4)))}
    r = r.withColumns({k: v.cast("double") for k, v in parts.items()} | {"moved_bytes": (moved * (branches - 1)).cast("long")})
    return r.groupBy(*rows.columns).agg(*[F.round(F.sum(p), 9).alias(p) for p in parts], F.sum("moved_bytes").alias("moved_bytes"))


@query(f"SELECT conv_id, context_tokens, output_tokens, num_agents, branch_factor, round(sum(t * 2e-4), 9) AS prefill_sec, round(sum(CASE WHEN b > 1 THEN m / 25e9 + 5e-5 ELSE 0 END), 9) AS transfer_sec, round(sum(CASE WHEN r = 0 THEN 0.0001 ELSE 0.00005 END), 9) AS resume_sec, round(sum(output_tokens * 5e-5), 9) AS decode_sec, round(sum(0.00005 * (2 + least(b, 4))), 9) AS omega_sec, sum(m * (b - 1))::BIGINT AS moved_bytes FROM (SELECT *, CASE WHEN r = 0 THEN context_tokens ELSE greatest(1, floor(context_tokens * (1 - 0.85::DOUBLE) + 1e-9)) END AS t, CASE WHEN r = 0 THEN context_tokens * 512 ELSE floor(context_tokens * 512 * (1 - 0.85::DOUBLE) + 1e-9) END AS m, greatest(1, num_agents * branch_factor) AS b FROM ({GRID}), (SELECT unnest(range(4)) AS r)) GROUP BY 1, 2, 3, 4, 5")
def stateful_critical_path(spark, sf_dir):
    return stateful_path(workload_grid(spark, sf_dir), 4)


ASKED_MODELS = ("gpt2", "org/gpt2", "DistilGPT2-finetuned", "Mistral-7B-v0.1", "Qwen2-7B", "Qwen2.5-32B-AWQ", "Llama-3-8B", "huggyllama/llama-7b", "Llama-3.1-70B", "unknown")


@query("SELECT conv_id, model_id, context_tokens * layers * 2 * kv_heads * (hidden // heads) * dtype_bytes AS kv_bytes, layers FROM (SELECT a.*, p.*, row_number() OVER (PARTITION BY a.conv_id ORDER BY pos) AS r FROM (SELECT conv_id, context_tokens, " + str(list(ASKED_MODELS)) + "[conv_id % 10 + 1] AS model_id FROM (" + GRID + ")) AS a JOIN (VALUES (0, 'distilgpt2', 6, 768, 12, 12, 4), (1, '=gpt2', 12, 768, 12, 12, 4), (2, 'mistral-7b', 32, 4096, 8, 32, 2), (3, 'qwen2.5-7b', 28, 3584, 4, 28, 2), (4, 'qwen2-7b', 28, 3584, 4, 28, 2), (5, 'qwen2.5-32b', 64, 5120, 8, 40, 2), (6, 'qwen2-32b', 64, 5120, 8, 40, 2), (7, 'llama-3-8b', 32, 4096, 8, 32, 2), (8, 'llama-2-7b', 32, 4096, 32, 32, 2), (9, 'llama-7b', 32, 4096, 32, 32, 2), (10, '70b', 80, 8192, 8, 64, 2), (11, '', 32, 4096, 8, 32, 2)) AS p(pos, pattern, layers, hidden, kv_heads, heads, dtype_bytes) ON CASE WHEN pattern = '=gpt2' THEN lower(a.model_id) = 'gpt2' OR lower(a.model_id) LIKE '%/gpt2' ELSE contains(lower(a.model_id), pattern) END) WHERE r = 1")
def model_lookup(spark, sf_dir):
    """Dimensions of the model that a conversation names, by id or by the first pattern that fits, as bytes of its state."""
    low = F.lower("model_id")
    fits = F.when(low.contains("distilgpt2"), 0).when((low == "gpt2") | low.endswith("/gpt2"), -1)
    for i, (pattern, *_) in enumerate(PATTERNS):
        fits = fits.when(low.contains(pattern), i)
    named = F.element_at(F.array(*map(F.lit, ASKED_MODELS)), (F.col("conv_id") % 10 + 1).cast("int"))
    rows = workload_grid(spark, sf_dir).select("conv_id", "context_tokens", named.alias("model_id")).withColumn("at", fits)
    known = spark.createDataFrame([(-1, 12, 768, 12, 12, 4), *[(i, *p[1:]) for i, p in enumerate(PATTERNS)]], "at int, layers int, hidden int, kv_heads int, heads int, dtype_bytes int")
    return rows.join(F.broadcast(known), "at").select("conv_id", "model_id", model_kv_bytes(F.col("context_tokens")).alias("kv_bytes"), "layers")


@query("""SELECT conv_id, context_tokens, num_agents, branch_factor, label, round(prefill + decode + moved + resume + omega, 9) AS total_sec, round(prefill + decode / output_tokens, 9) AS ttft_sec, available, reason FROM (SELECT *, unnest([
{label: 'dense_prefill', prefill: n * m, decode: n * d, moved: 0.0, resume: 0.0, omega: n * 0.00005, available: true, reason: ''},
{label: 'vllm_local_prefix', prefill: m, decode: n * d, moved: 0.0, resume: n * 0.0001, omega: n * 0.00005, available: false, reason: 'simulated'},
{label: 'distserve_style', prefill: m, decode: n * d, moved: context_tokens * 36864.0 / 25e9 + 0.00005, resume: n * 0.0001, omega: n * 0.00005, available: true, reason: ''}], recursive := true) FROM
(SELECT *, num_agents * branch_factor AS n, greatest(1e-6, context_tokens * 0.0002) AS m, output_tokens * 0.00005 AS d FROM (""" + GRID + """)))""")
def measured_rows(spark, sf_dir):
    """One estimated measurement of a model expanded to rows of several baselines, with availability and reason."""
    n, m, d = F.col("num_agents") * F.col("branch_factor"), F.greatest(F.lit(1e-6), F.col("context_tokens") * 0.0002), F.col("output_tokens") * 5e-5
    c, zero = COST, F.lit(0.0)
    bytes_ = F.col("context_tokens") * (12 * 2 * 768 * 4 // 2)
    ways = {
        "dense_prefill": (n * m, n * d, zero, zero, n * c["omega_text"], True, ""),
        "vllm_local_prefix": (m, n * d, zero, n * c["resume"], n * c["omega_state"], False, "simulated"),
        "distserve_style": (m, n * d, bytes_ / c["bandwidth"] + c["latency"], n * c["resume"], n * c["omega_state"], True, ""),
    }
    made = [F.struct(F.lit(k).alias("label"), (p + x + t + r + o).alias("total_sec"), (p + x / F.col("output_tokens")).alias("ttft_sec"), F.lit(a).alias("available"), F.lit(w).alias("reason")) for k, (p, x, t, r, o, a, w) in ways.items()]
    out = workload_grid(spark, sf_dir).select("conv_id", "context_tokens", "num_agents", "branch_factor", F.explode(F.array(*made)).alias("b"))
    return out.select("conv_id", "context_tokens", "num_agents", "branch_factor", "b.label", F.round("b.total_sec", 9).alias("total_sec"), F.round("b.ttft_sec", 9).alias("ttft_sec"), "b.available", "b.reason")
