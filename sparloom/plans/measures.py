"""Queries over events: latency, throughput, percentiles, run summaries, agreement."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..registry import query, table


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def r6(c):
    return F.round(c, 6)


@query("SELECT event_type AS name, count(*) AS n, round(sum(value), 4) AS total_sec, round(avg(value) * 1000, 4) AS avg_ms, coalesce(round(min(value) * 1000, 4), 0) AS min_ms, coalesce(round(max(value) * 1000, 4), 0) AS max_ms FROM events GROUP BY 1")
def latency_summary(spark, sf_dir):
    ms = lambda c: F.round(c * 1000, 4)
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total_sec"), ms(F.avg("value")).alias("avg_ms"), F.coalesce(ms(F.min("value")), F.lit(0)).alias("min_ms"), F.coalesce(ms(F.max("value")), F.lit(0)).alias("max_ms"))


@query("SELECT event_type AS level, count(*) AS n, round(avg(value), 6) AS avg_latency_s, CASE WHEN count(*) = 0 THEN NULL WHEN avg(value) > 0 THEN round(1 / avg(value), 6) ELSE 'Infinity'::DOUBLE END AS throughput_per_s FROM events GROUP BY 1")
def throughput(spark, sf_dir):
    a = F.avg("value")
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("level")).agg(F.count("*").alias("n"), r6(a).alias("avg_latency_s"), F.when(a > 0, r6(1 / a)).otherwise(F.lit(float("inf"))).alias("throughput_per_s"))


@query("SELECT event_type, count(*) AS n, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0 END), 6) AS hit_rate, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def p50_p95(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), r6(F.avg((F.col("value") > 50).cast("int"))).alias("hit_rate"), r6(F.percentile("value", 0.5)).alias("p50"), r6(F.percentile("value", 0.95)).alias("p95"))


@query("SELECT event_type, round(median(s), 4) AS median_sec, round(median(n))::BIGINT AS median_n FROM (SELECT event_type, ts::DATE AS d, sum(value) AS s, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def repeat_median(spark, sf_dir):
    """Days as repeats of one run."""
    days = events(spark, sf_dir).groupBy("event_type", F.to_date("ts").alias("d")).agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    return days.groupBy("event_type").agg(F.round(F.median("s"), 4).alias("median_sec"), F.round(F.median("n")).cast("long").alias("median_n"))


@query("SELECT event_type, sum(n)::BIGINT AS n, round(max(s), 4) AS slowest_sec, round(sum(n) / max(s), 6) AS per_sec FROM (SELECT event_type, user_id % 8 AS rank, sum(value) AS s, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def rank_combine(spark, sf_dir):
    """Counts add up over ranks, times take the slowest."""
    ranks = events(spark, sf_dir).groupBy("event_type", (F.col("user_id") % 8).alias("rank")).agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    return ranks.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.max("s"), 4).alias("slowest_sec"), r6(F.sum("n") / F.max("s")).alias("per_sec"))


@query("SELECT user_id, CASE WHEN sum(n) >= 2 THEN round(max(n) / sum(n), 6) END AS agreement FROM (SELECT user_id, lower(trim(event_type)) AS t, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def agreement(spark, sf_dir):
    """Share of the commonest output; fewer than two outputs: null."""
    per = events(spark, sf_dir).groupBy("user_id", F.lower(F.trim("event_type")).alias("t")).agg(F.count("*").alias("n"))
    return per.groupBy("user_id").agg(F.when(F.sum("n") >= 2, r6(F.max("n") / F.sum("n"))).alias("agreement"))


@query("SELECT user_id, event_id, live, max(live) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS peak FROM (SELECT user_id, event_id, sum(CASE WHEN event_type = 'purchase' THEN 7 ELSE 3 END * CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS live FROM events)")
def running_peak(spark, sf_dir):
    so_far = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    change = F.when(F.col("event_type") == "purchase", 7).otherwise(3) * F.when(F.col("event_id") % 3 == 0, -1).otherwise(1)
    live = events(spark, sf_dir).select("user_id", "event_id", F.sum(change).over(so_far).alias("live"))
    return live.withColumn("peak", F.max("live").over(so_far))


#: Which total a run's event adds to, and which lifecycle counter; fixed values.
DURATIONS = {"prefill": "prefill_sec", "decode": "decode_sec", "transfer": "transfer_sec", "resume": "resume_sec", "overhead": "omega_sec"}


def run_events(spark, sf_dir):
    """events as run events: the run is the user, the name follows from the id, the bytes from the value."""
    names = ["prefill", "decode", "transfer", "resume", "overhead", "fork", "merge", "evict"]
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 8 + 1).cast("int"))
    return events(spark, sf_dir).select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), name.alias("name"), F.col("value").alias("sec"), F.floor(F.col("value") * 100).cast("long").alias("bytes"))


RUNS = "SELECT user_id AS run_id, event_id AS seq, ['prefill', 'decode', 'transfer', 'resume', 'overhead', 'fork', 'merge', 'evict'][event_id % 8 + 1] AS name, value AS sec, floor(value * 100)::BIGINT AS bytes FROM events"
RUN_SUMS = ", ".join(f"round(coalesce(sum(sec) FILTER (WHERE name = '{k}'), 0), 4) AS {v}" for k, v in DURATIONS.items())


@query(f"""SELECT run_id, {RUN_SUMS}, round(coalesce(sum(sec) FILTER (WHERE name IN ('prefill', 'decode', 'transfer', 'resume', 'overhead')), 0), 4) AS total_latency_sec,
coalesce(sum(bytes) FILTER (WHERE name = 'prefill'), 0)::BIGINT AS kv_total_bytes, coalesce(sum(bytes) FILTER (WHERE name = 'transfer'), 0)::BIGINT AS kv_transferred_bytes,
count(*) FILTER (WHERE name = 'prefill') AS materialize_count, count(*) FILTER (WHERE name = 'transfer') AS transfer_count, count(*) FILTER (WHERE name = 'fork') AS fork_count,
count(*) FILTER (WHERE name = 'merge') AS merge_count, count(*) FILTER (WHERE name = 'evict') AS evict_count,
round(count(*) FILTER (WHERE name = 'resume') / greatest(1, count(*) FILTER (WHERE name = 'resume') + count(*) FILTER (WHERE name = 'prefill')), 6) AS kv_reuse_ratio FROM ({RUNS}) GROUP BY run_id""")
def run_summary(spark, sf_dir):
    """A run's events folded to one row: sums by kind, byte totals, lifecycle counts, reuse."""
    is_ = lambda n: F.col("name") == n
    sums = [F.round(F.coalesce(F.sum(F.when(is_(k), F.col("sec"))), F.lit(0.0)), 4).alias(v) for k, v in DURATIONS.items()]
    total = F.round(F.coalesce(F.sum(F.when(F.col("name").isin(*DURATIONS), F.col("sec"))), F.lit(0.0)), 4).alias("total_latency_sec")
    byte = [F.coalesce(F.sum(F.when(is_(k), F.col("bytes"))), F.lit(0)).alias(v) for k, v in (("prefill", "kv_total_bytes"), ("transfer", "kv_transferred_bytes"))]
    counts = [F.count_if(is_(k)).alias(v) for k, v in (("prefill", "materialize_count"), ("transfer", "transfer_count"), ("fork", "fork_count"), ("merge", "merge_count"), ("evict", "evict_count"))]
    reuse = r6(F.count_if(is_("resume")) / F.greatest(F.lit(1), F.count_if(is_("resume")) + F.count_if(is_("prefill")))).alias("kv_reuse_ratio")
    return run_events(spark, sf_dir).groupBy("run_id").agg(*sums, total, *byte, *counts, reuse)


@query(f"SELECT run_id, min(seq) AS first_seq, round(sum(sec), 6) AS ttft_sec FROM (SELECT *, min(CASE WHEN name = 'decode' THEN seq END) OVER (PARTITION BY run_id) AS stop FROM ({RUNS})) WHERE name IN ('prefill', 'transfer', 'decode') AND seq <= stop GROUP BY run_id")
def time_to_first_token(spark, sf_dir):
    """Prefill and transfer up to, and the first, decode."""
    stop = F.min(F.when(F.col("name") == "decode", F.col("seq"))).over(Window.partitionBy("run_id"))
    rows = run_events(spark, sf_dir).withColumn("stop", stop).where(F.col("name").isin("prefill", "transfer", "decode") & (F.col("seq") <= F.col("stop")))
    return rows.groupBy("run_id").agg(F.min("seq").alias("first_seq"), r6(F.sum("sec")).alias("ttft_sec"))


@query("SELECT event_type AS series, date_part('hour', ts)::BIGINT AS x, round(avg(value * 1000), 4) AS y FROM events GROUP BY 1, 2")
def group_xy(spark, sf_dir):
    """Chart points: mean of y by series and x."""
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("series"), F.hour("ts").cast("long").alias("x")).agg(F.round(F.avg(F.col("value") * 1000), 4).alias("y"))


SPEED = "SELECT user_id AS workload, event_type AS baseline, avg(value) AS lat, count(*) AS n FROM events GROUP BY 1, 2"


@query(f"SELECT s.workload, s.baseline, s.n, round(s.lat, 6) AS latency, CASE WHEN s.lat > 0 THEN round(r.lat / s.lat, 6) END AS speedup, CASE WHEN r.lat <= 0 THEN 0 ELSE round((r.lat - s.lat) / r.lat * 100, 4) END AS pct_faster FROM ({SPEED}) s LEFT JOIN ({SPEED}) r ON r.workload = s.workload AND r.baseline = 'view'")
def speedup_table(spark, sf_dir):
    """Each baseline beside the reference baseline of its workload."""
    means = events(spark, sf_dir).groupBy(F.col("user_id").alias("workload"), F.col("event_type").alias("baseline")).agg(F.avg("value").alias("lat"), F.count("*").alias("n"))
    ref = F.max(F.when(F.col("baseline") == "view", F.col("lat"))).over(Window.partitionBy("workload"))
    out = means.withColumn("ref", ref)
    return out.select("workload", "baseline", "n", r6("lat").alias("latency"), F.when(F.col("lat") > 0, r6(F.col("ref") / F.col("lat"))).alias("speedup"), F.when(F.col("ref") <= 0, 0).otherwise(F.round((F.col("ref") - F.col("lat")) / F.col("ref") * 100, 4)).alias("pct_faster"))


@query("SELECT user_id AS run, coalesce(min_by(total, prio) FILTER (WHERE prio < 9 AND total > 0), sum(total)) AS runtime_ms, max(total) AS longest_ms FROM (SELECT user_id, sum(floor(value * 1000)::BIGINT)::BIGINT AS total, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 9 END AS prio FROM events GROUP BY user_id, event_type) GROUP BY 1")
def runtime_estimate(spark, sf_dir):
    """The first preferred metric above 0, else the sum of all stages."""
    prio = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", 2).otherwise(9)
    rows = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.sum(F.floor(F.col("value") * 1000).cast("long")).alias("total")).withColumn("prio", prio)
    wanted = (F.col("prio") < 9) & (F.col("total") > 0)
    first = F.min_by(F.when(wanted, F.col("total")), F.when(wanted, F.col("prio")))
    return rows.groupBy(F.col("user_id").alias("run")).agg(F.coalesce(first, F.sum("total")).alias("runtime_ms"), F.max("total").alias("longest_ms"))


@query("SELECT event_id, len(json_keys(props)) AS n_keys, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events")
def props_json(spark, sf_dir):
    keys = F.array_sort(F.json_object_keys("props"))
    return events(spark, sf_dir).select("event_id", F.size(keys).alias("n_keys"), F.array_join(keys, ",").alias("keys"))


@query("SELECT user_id, count(*) AS ops, round(count(*) / greatest(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6, 1e-9), 6) AS ops_per_s FROM events GROUP BY 1 HAVING count(*) > 1")
def ops_throughput(spark, sf_dir):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    span = F.greatest((F.max(at) - F.min(at)) / 1e6, F.lit(1e-9))
    return events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("ops"), r6(F.count("*") / span).alias("ops_per_s")).where("ops > 1")


@query("SELECT event_id, CASE WHEN lower(event_type) LIKE 'p%' THEN 'paid' WHEN lower(event_type) IN ('view', 'click') THEN 'browse' ELSE 'other' END AS family, TRY_CAST(nullif(trim(props), '') AS DOUBLE) AS number, greatest(0, least(1, coalesce(value / 100, 0))) AS bounded, coalesce(value > 50, true) AS usable FROM events")
def row_predicates(spark, sf_dir):
    """Tolerant casts, prefix families, clamps and usable flags."""
    low = F.lower("event_type")
    family = F.when(low.startswith("p"), "paid").when(low.isin("view", "click"), "browse").otherwise("other")
    return events(spark, sf_dir).select("event_id", family.alias("family"), F.nullif(F.trim("props"), F.lit("")).try_cast("double").alias("number"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("value") / 100, F.lit(0.0)))).alias("bounded"), F.coalesce(F.col("value") > 50, F.lit(True)).alias("usable"))


WIDE = ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS {t}" for t in ("click", "purchase", "view"))


@query(f"SELECT key, sum(n)::BIGINT AS n FROM (SELECT user_id, {WIDE} FROM events GROUP BY 1) UNPIVOT (n FOR key IN (click, purchase, view)) GROUP BY key")
def combine_metric_maps(spark, sf_dir):
    """Per-file metric maps, exploded and added up by key."""
    maps = events(spark, sf_dir).groupBy("user_id").agg(*[F.count_if(F.col("event_type") == t).alias(t) for t in ("click", "purchase", "view")])
    m = F.create_map(*[x for t in ("click", "purchase", "view") for x in (F.lit(t), F.col(t))])
    return maps.select(F.explode(m).alias("key", "n")).groupBy("key").agg(F.sum("n").alias("n"))


PAIR = "SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9_]+') AS a, regexp_extract_all(lower(lead(text) OVER (PARTITION BY conv_id ORDER BY turn)), '[a-z0-9_]+') AS b FROM conversations"


@query(f"""SELECT conv_id, turn, CASE WHEN greatest(len(a), len(b)) = 0 THEN 1.0 ELSE round(len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i])) / greatest(len(a), len(b)), 6) END AS match_rate,
coalesce(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])[1] - 1, CASE WHEN len(a) <> len(b) THEN least(len(a), len(b)) END) AS divergence, a = b AS exact FROM ({PAIR}) WHERE b IS NOT NULL""")
def output_consistency(spark, sf_dir):
    """Each turn's tokens against the next turn's: match rate and first divergence."""
    from ..functions.text import tokens

    rows = table(spark, sf_dir, "conversations")
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    both = rows.withColumn("nxt", nxt).where("nxt is not null").select("conv_id", "turn", tokens(F.col("text")).alias("a"), tokens(F.col("nxt")).alias("b"))
    from ..operators.consistency import divergence, match_rate

    return both.select("conv_id", "turn", r6(match_rate(F.col("a"), F.col("b"))).alias("match_rate"), divergence(F.col("a"), F.col("b")).alias("divergence"), (F.col("a") == F.col("b")).alias("exact"))


@query(f"""SELECT count(*) AS pairs, count(*) FILTER (WHERE a = b) AS exact, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0 END), 6) AS exact_rate,
array_to_string(list_sort(list_distinct(list(CASE WHEN a = b THEN 'equal' WHEN len(a) <> len(b) THEN 'length' ELSE 'token' END))), ',') AS causes FROM ({PAIR}) WHERE b IS NOT NULL""")
def consistency_summary(spark, sf_dir):
    """Counts, exact rate and the distinct causes of mismatch over all compared pairs."""
    from ..functions.text import tokens

    rows = table(spark, sf_dir, "conversations")
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    both = rows.withColumn("nxt", nxt).where("nxt is not null").select(tokens(F.col("text")).alias("a"), tokens(F.col("nxt")).alias("b"))
    same = F.col("a") == F.col("b")
    cause = F.when(same, "equal").when(F.size("a") != F.size("b"), "length").otherwise("token")
    return both.agg(F.count("*").alias("pairs"), F.count_if(same).alias("exact"), r6(F.avg(same.cast("int"))).alias("exact_rate"), F.array_join(F.array_sort(F.collect_set(cause)), ",").alias("causes"))


@query("SELECT name, stat, value FROM (SELECT event_type AS name, count(*)::DOUBLE AS n, round(sum(value), 4) AS total, round(min(value), 6) AS least, round(max(value), 6) AS most FROM events GROUP BY 1) UNPIVOT (value FOR stat IN (n, total, least, most))")
def metric_rows(spark, sf_dir):
    """Summaries in long form: one row a name and statistic."""
    wide = events(spark, sf_dir).groupBy(F.col("event_type").alias("name")).agg(F.count("*").cast("double").alias("n"), F.round(F.sum("value"), 4).alias("total"), r6(F.min("value")).alias("least"), r6(F.max("value")).alias("most"))
    return wide.unpivot(["name"], ["n", "total", "least", "most"], "stat", "value")


@query("SELECT baseline, workload, n, usable, round(mean, 6) AS mean_value, CASE WHEN ref > 0 THEN round(mean / ref, 6) END AS over_ref FROM (SELECT *, max(mean) FILTER (WHERE baseline = 'view') OVER (PARTITION BY workload) AS ref FROM (SELECT event_type AS baseline, user_id % 16 AS workload, count(*) AS n, count(*) FILTER (WHERE value > 10) AS usable, avg(value) FILTER (WHERE value > 10) AS mean FROM events GROUP BY 1, 2))")
def experiment_summary(spark, sf_dir):
    """Means over usable rows by baseline and workload, beside the reference baseline."""
    ok = F.col("value") > 10
    rows = events(spark, sf_dir).groupBy(F.col("event_type").alias("baseline"), (F.col("user_id") % 16).alias("workload")).agg(F.count("*").alias("n"), F.count_if(ok).alias("usable"), F.avg(F.when(ok, F.col("value"))).alias("mean"))
    ref = F.max(F.when(F.col("baseline") == "view", F.col("mean"))).over(Window.partitionBy("workload"))
    return rows.withColumn("ref", ref).select("baseline", "workload", "n", "usable", r6("mean").alias("mean_value"), F.when(F.col("ref") > 0, r6(F.col("mean") / F.col("ref"))).alias("over_ref"))
