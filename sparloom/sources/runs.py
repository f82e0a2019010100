"""Files that runs leave behind: serving logs, metric maps, result tables; readers and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Phrases of a serving log's labels and what stands for them, in this order; fixed values.
PHRASES = {"time to first token": "ttft", "time per output token": "tpot", "inter-token latency": "itl", "end-to-end latency": "e2el", "end to end latency": "e2el", "(ms)": " ms", "(s)": " sec", "(req/s)": " req_s", "(tok/s)": " tok_s", "%": "pct", "#": "num"}
#: Names under which metrics are asked for, and the labels that give them, first come first; fixed values.
ALIASES = {
    "ttft_sec": ("mean_ttft_sec", "median_ttft_sec", "p50_ttft_sec"),
    "tpot_sec": ("mean_tpot_sec", "median_tpot_sec", "p50_tpot_sec"),
    "itl_sec": ("mean_itl_sec", "median_itl_sec", "p50_itl_sec"),
    "e2el_sec": ("mean_e2el_sec", "median_e2el_sec", "p50_e2el_sec", "mean_request_latency_sec"),
    "throughput_tokens_per_sec": ("output_token_throughput_tok_s", "total_token_throughput_tok_s", "token_throughput_tok_s"),
    "request_throughput_req_per_sec": ("request_throughput_req_s",),
}


def log_label(label: Column) -> Column:
    """A label as a name of small letters, digits and underscores."""
    out = F.lower(F.trim(label))
    for phrase, short in PHRASES.items():
        out = F.replace(out, F.lit(phrase), F.lit(short))
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", "_"), F.lit("_"))


def log_metrics(lines: DataFrame, key: list[str] | None = None) -> DataFrame:
    """key..., metric, value: every `label: number` line (value string), milliseconds also as seconds, and aliases.

    A later line of the same label wins by `at` where the frame has it.
    """
    key = key or []
    at = F.col("at") if "at" in lines.columns else F.lit(0)
    label = F.regexp_extract("value", r"^\s*([^:]+):\s*\S", 1)
    number = F.regexp_extract("value", r":\s*(\S+)", 1).try_cast("double")
    rows = lines.select(*key, at.alias("at"), log_label(label).alias("metric"), number.alias("value")).where("metric <> '' and value is not null")
    seconds = rows.where(F.col("metric").endswith("_ms")).select(*key, "at", F.concat(F.expr("left(metric, length(metric) - 3)"), F.lit("_sec")).alias("metric"), (F.col("value") / 1000).alias("value"))
    named = rows.union(seconds).groupBy(*key, "metric").agg(F.max_by("value", "at").alias("value"))
    told = named.sparkSession.createDataFrame([(a, m, i) for a, ms in ALIASES.items() for i, m in enumerate(ms)], "alias string, metric string, place int")
    aliased = named.join(F.broadcast(told), "metric").groupBy(*key, F.col("alias").alias("metric")).agg(F.min_by("value", "place").alias("value"))
    return named.unionByName(aliased)


def metric_entry(entry: Column) -> Column:
    """struct(count, seconds) of a metric's JSON: totals under any usual name, else the sum of its samples, in seconds if their median is 10 or less."""
    number = lambda k: F.get_json_object(entry, f"$.{k}").try_cast("double")
    count = F.coalesce(number("count"), number("n"), F.lit(0.0)).cast("long")
    named = F.coalesce(*[number(k) for k in ("total_time_s", "total_s", "sum_s", "total_time", "sum", "total", "total_sec")], F.lit(0.0))
    samples = F.filter(F.coalesce(F.from_json(F.get_json_object(entry, "$.samples"), "array<double>"), F.array().cast("array<double>")), lambda x: x >= 0)
    total = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x)
    middle = F.get(F.array_sort(samples), F.floor(F.size(samples) / 2).cast("int"))
    return F.struct(count.alias("count"), F.when(named != 0, named).when(F.size(samples) == 0, 0.0).when(middle > 10, total / 1000).otherwise(total).alias("seconds"))


def read_metric_files(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(file, metric, count, seconds) of every JSON metric map below a folder."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    maps = raw.select("file", F.explode(F.from_json("value", "map<string,string>")).alias("metric", "entry"))
    return maps.select("file", "metric", metric_entry(F.col("entry")).alias("e")).select("file", "metric", "e.count", "e.seconds")


def write_results(rows: DataFrame, path: str, first: list[str]) -> None:
    """A CSV with the columns of `first`, then all others by name; nulls are empty cells."""
    order = [c for c in first if c in rows.columns] + sorted(c for c in rows.columns if c not in first)
    rows.select(*order).coalesce(1).write.mode("error").option("header", True).option("nullValue", "").csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def latex(rows: DataFrame, most: int = 200) -> str:
    """A small frame as a LaTeX table; more than `most` rows are an error."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows")
    escape = lambda v: "" if v is None else str(v).replace("_", r"\_").replace("%", r"\%")
    body = [" & ".join(map(escape, r)) + r" \\" for r in found]
    return "\n".join([r"\begin{tabular}{" + "l" * len(rows.columns) + "}", " & ".join(map(escape, rows.columns)) + r" \\ \hline", *body, r"\end{tabular}"])


#: Environment names of a task's number and of how many there are, in this order; fixed values.
RANKS = (("SLURM_PROCID", "SLURM_STEP_NUM_TASKS"), ("SLURM_PROCID", "SLURM_NTASKS"), ("PMI_RANK", "PMI_SIZE"), ("PMIX_RANK", "PMIX_SIZE"), ("OMPI_COMM_WORLD_RANK", "OMPI_COMM_WORLD_SIZE"), ("RANK", "WORLD_SIZE"))


def rank_world(env: dict[str, str]) -> tuple[int, int]:
    """(rank, world) that a launcher's environment names, else (0, 1); ranks wrap at the world."""
    for rank, world in RANKS:
        if rank in env and world in env:
            size = max(1, int(env[world]))
            return int(env[rank]) % size, size
    return 0, 1


def text_column(rows: DataFrame, asked: str | None = None) -> str:
    """The column that holds text: the one asked for, a usual name, else the first of strings."""
    if asked:
        if asked not in rows.columns:
            raise ValueError(f"no column {asked}")
        return asked
    strings = [f.name for f in rows.schema if f.dataType.typeName() == "string"]
    usual = [n for n in ("text", "content", "document", "body", "passage", "sentence") if n in strings]
    if not strings:
        raise ValueError("no column of strings")
    return (usual or strings)[0]


def export_texts(rows: DataFrame, path: str, column: str | None = None, cap: int | None = None) -> int:
    """One line a text, blank ones left out, at most `cap`; returns how many."""
    name = text_column(rows, column)
    kept = rows.select(F.regexp_replace(name, r"\s+", " ").alias("value")).where(F.trim("value") != "")
    kept = kept.limit(cap) if cap is not None else kept
    kept.write.mode("error").text(path)
    return rows.sparkSession.read.text(path).count()
