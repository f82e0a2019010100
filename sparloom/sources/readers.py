"""Readers and writers: texts, JSON, CSV, queries, metrics, logs; all give (text, meta) or typed rows."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {"csv": ",", "tsv": "\t"}


def _meta(columns: dict[str, Column]) -> Column:
    return F.map_filter(F.create_map(*[x for k, v in columns.items() for x in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull())


def read_texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Whole files as (text, meta); bytes that are no UTF-8 are dropped, empty files left out."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    return raw.select(text.alias("text"), _meta({"source_file": F.col("path")}).alias("meta")).where("text <> ''")


def read_json(spark: SparkSession, path: str, text_key: str = "text", lines: bool = True) -> DataFrame:
    """JSON objects (one a line, or whole files with an object or a list) as (text, meta); faulty lines are left out."""
    rows = spark.read.option("multiLine", not lines).option("mode", "DROPMALFORMED").json(path)
    others = {c: (F.to_json(F.col(c)) if rows.schema[c].dataType.typeName() in ("struct", "array", "map") else F.col(c)) for c in rows.columns if c != text_key}
    text = F.col(text_key) if text_key in rows.columns else F.lit("")
    return rows.select(F.coalesce(text.cast("string"), F.lit("")).alias("text"), _meta(others | {"source_file": F.input_file_name()}).alias("meta")).where("text <> ''")


def read_table_files(spark: SparkSession, path: str, sep: str = ",", text_column: str = "text") -> DataFrame:
    """CSV or TSV with a header as (text, meta); without text_column the first column is the text."""
    rows = spark.read.option("header", True).option("sep", sep).csv(path)
    name = text_column if text_column in rows.columns else rows.columns[0]
    others = {c: F.col(f"`{c}`") for c in rows.columns if c != name}
    return rows.select(F.coalesce(F.col(f"`{name}`"), F.lit("")).alias("text"), _meta(others | {"source_file": F.input_file_name()}).alias("meta")).where("text <> ''")


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """Every file of a folder by its suffix, unknown suffixes as texts; folders inside are skipped."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop)
    files = sorted(str(f.getPath()) for f in listed if f.isFile() and not f.getPath().getName().startswith(("_", ".")))
    by: dict[str, list[str]] = {}
    for f in files:
        by.setdefault(f.rsplit(".", 1)[-1].lower() if "." in f.rsplit("/", 1)[-1] else "", []).append(f)
    out = spark.createDataFrame([], "text string, meta map<string,string>")
    for suffix, paths in by.items():
        if suffix in TABLES:
            for p in paths:  # headers differ
                out = out.unionByName(read_table_files(spark, p, TABLES[suffix]))
        elif suffix in ("json", "jsonl"):
            for p in paths:
                out = out.unionByName(read_json(spark, p, lines=suffix == "jsonl"))
        else:
            raw = spark.read.format("binaryFile").load(paths)
            text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
            out = out.unionByName(raw.select(text.alias("text"), _meta({"source_file": F.col("path")}).alias("meta")).where("text <> ''"))
    return out


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query) of JSON lines with `query`, else `text`; faulty and blank ones are left out."""
    rows = spark.read.option("mode", "DROPMALFORMED").schema("query string, text string").json(path)
    asked = F.coalesce(F.nullif(F.trim("query"), F.lit("")), F.nullif(F.trim("text"), F.lit("")))
    out = rows.select(F.input_file_name().alias("file"), asked.alias("query")).where("query is not null")
    return out.select(F.concat(F.element_at(F.split("file", "/"), -1), F.lit("#"), F.substring(F.md5("query"), 1, 8)).alias("query_id"), "query")


#: A serving log's labels and the names of their metrics; fixed values.
LOG_LABELS = {"mean ttft (ms)": ("ttft_sec", 1e-3), "mean tpot (ms)": ("tpot_sec", 1e-3), "mean itl (ms)": ("itl_sec", 1e-3), "mean e2el (ms)": ("e2el_sec", 1e-3), "output token throughput (tok/s)": ("tokens_per_sec", 1.0), "request throughput (req/s)": ("requests_per_sec", 1.0), "successful requests": ("requests", 1.0), "benchmark duration (s)": ("duration_sec", 1.0)}


def read_log(lines: DataFrame) -> DataFrame:
    """(metric, value) of a serving log's `label: number` lines (value string)."""
    label = F.lower(F.trim(F.regexp_extract("value", r"^\s*([^:]+):\s*[-+0-9.eE]+\s*$", 1)))
    number = F.regexp_extract("value", r":\s*([-+0-9.eE]+)\s*$", 1).try_cast("double")
    names = F.create_map(*[x for k, (n, _) in LOG_LABELS.items() for x in (F.lit(k), F.lit(n))])
    scale = F.create_map(*[x for k, (_, s) in LOG_LABELS.items() for x in (F.lit(k), F.lit(s))])
    out = lines.select(F.try_element_at(names, label).alias("metric"), (number * F.try_element_at(scale, label)).alias("value"))
    return out.where("metric is not null and value is not null")


def shard(df: DataFrame, order: list[str], rank: int, world: int, cap: int | None = None) -> DataFrame:
    """Rows whose place modulo world is rank; cap: so many of them at most, first by order."""
    from .sharding import with_index

    mine = with_index(df, order, "_i").where(F.pmod("_i", F.lit(max(1, world))) == rank % max(1, world))
    return (mine.orderBy("_i").limit(cap) if cap is not None else mine).drop("_i")


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """With a header; nulls are empty cells."""
    df.write.mode(mode).option("header", True).option("nullValue", "").csv(path)


def ready(spark: SparkSession, path: str) -> bool:
    """Whether a folder was written to its end: its _SUCCESS file is there."""
    flag = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return flag.getFileSystem(spark._jsc.hadoopConfiguration()).exists(flag)


def wait_ready(spark: SparkSession, paths: list[str], seconds: float, every: float = 0.5) -> None:
    """Returns when all folders are written; raises TimeoutError, naming those that are not, after `seconds`."""
    end = time.monotonic() + seconds
    while left := [p for p in paths if not ready(spark, p)]:
        if time.monotonic() >= end:
            raise TimeoutError(f"not ready after {seconds} s: {', '.join(left)}")
        time.sleep(every)


def barrier(spark: SparkSession, folder: str, rank: int, world: int, seconds: float) -> None:
    """Marks this rank as arrived in a shared folder and waits for all others."""
    spark.range(1).select(F.lit(rank).alias("rank")).coalesce(1).write.mode("overwrite").json(f"{folder}/rank={rank}")
    wait_ready(spark, [f"{folder}/rank={r}" for r in range(world)], seconds)


def cached_corpus(spark: SparkSession, build, root: str, **parameters) -> DataFrame:
    """A generated corpus, written once under a folder named by its parameters and read from then on.

    A folder that was not written to its end is built again.
    """
    key = "-".join(f"{k}={v}" for k, v in sorted(parameters.items()))
    path = f"{root}/{key}"
    if not ready(spark, path):
        build(spark, **parameters).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def built_once(rows: DataFrame, columns: list[str], name: str, build) -> str:
    """The folder of what build(rows, folder) makes of rows, built once for their content and loaded from then on.

    The folder is named by the rows' number and the sum of their columns' hashes, and
    takes its name when it is written to its end (build writes a _SUCCESS flag last).
    """
    from ..session import shared_folder

    spark = rows.sparkSession
    n, total = rows.agg(F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first()
    path = f"{shared_folder(spark)}/{name}-{n}-{total or 0}"
    if not ready(spark, path):
        made = f"{path}-{uuid.uuid4().hex}"
        build(rows, made)
        here, there = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (made, path))
        system = here.getFileSystem(spark._jsc.hadoopConfiguration())
        if not ready(spark, path):
            system.delete(there, True)  # one that was not written to its end
            if not system.rename(here, there) and not ready(spark, path):
                raise OSError(f"cannot name {path}")
    return path
