"""Queries that generate workloads and synthetic corpora: requests by conversations, nodes by documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query, table

WORDS = ("agent", "state", "cache", "token", "branch", "merge", "route", "vector", "window", "plan", "stage", "query")
VOCABULARY = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"


def prompt(request: Column, role: Column, tokens: Column, seed: int) -> Column:
    """A role line and as many words as tokens, picked from a fixed vocabulary by md5."""
    def word(i: Column) -> Column:
        h = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(seed).cast("string"), request.cast("string"), i.cast("string"))), 1, 6), 16, 10).cast("int")
        return F.element_at(F.array(*map(F.lit, WORDS)), h % len(WORDS) + 1)

    return F.concat_ws(" ", role, F.array_join(F.transform(F.sequence(F.lit(0), tokens - 1), word), " "))


def _prompt_sql(role: str, tokens: str) -> str:
    return f"{role} || ' ' || array_to_string(list_transform(range({tokens}), lambda i: {VOCABULARY}[('0x' || substr(md5('7/' || request || '/' || i), 1, 6))::INT % {len(WORDS)} + 1]), ' ')"


def requests(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "request")


#: Requests: one a conversation.
ASKED = "(SELECT DISTINCT conv_id AS request FROM conversations)"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request")).distinct()


@query(f"SELECT request, 32 AS tokens, {_prompt_sql(chr(39) + 'hand over' + chr(39), '32')} AS prompt FROM {ASKED}")
def workload_linear(spark, sf_dir):
    return asked(spark, sf_dir).select("request", F.lit(32).alias("tokens"), prompt(F.col("request"), F.lit("hand over"), F.lit(32), 7).alias("prompt"))


@query(f"SELECT request, agent, 24 AS tokens, {_prompt_sql(chr(39) + 'debate agent ' + chr(39) + ' || agent', '24')} AS prompt FROM {ASKED}, (SELECT unnest(range(3)) AS agent)")
def workload_debate(spark, sf_dir):
    rows = asked(spark, sf_dir).withColumn("agent", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    return rows.select("request", "agent", F.lit(24).alias("tokens"), prompt(F.col("request"), F.concat(F.lit("debate agent "), F.col("agent").cast("string")), F.lit(24), 7).alias("prompt"))


@query("SELECT request, level, node, 64 + level * 8 AS tokens FROM (SELECT unnest(range(5)) AS request), (SELECT l AS level, unnest(range((2 ** l)::BIGINT)) AS node FROM (SELECT unnest(range(3)) AS l))")
def workload_tree(spark, sf_dir):
    rows = requests(spark, 5).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(2))))
    rows = rows.withColumn("node", F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2), F.col("level")).cast("long") - 1)))
    return rows.select("request", F.col("level").cast("long").alias("level"), "node", (64 + F.col("level").cast("long") * 8).alias("tokens"))


@query("SELECT row_number() OVER (ORDER BY m) - 1 AS request, greatest(1, (24 * m)::BIGINT) AS tokens FROM (SELECT unnest([0.25, 0.5, 1.0, 2.0, 4.0]) AS m)")
def workload_crossover(spark, sf_dir):
    return spark.range(1).select(F.posexplode(F.array(*[F.lit(m) for m in (0.25, 0.5, 1.0, 2.0, 4.0)])).alias("request", "m")).select(F.col("request").cast("long").alias("request"), F.greatest(F.lit(1), (24 * F.col("m")).cast("long")).alias("tokens"))


@query("SELECT request, item_id, 'answer from shared context: ' || text AS prompt FROM " + ASKED + " JOIN (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS idx, count(*) OVER () AS n FROM benchmark) ON idx = request % n")
def workload_shared_context(spark, sf_dir):
    """Requests take contexts in turn from a corpus."""
    from ..sources.sharding import with_index

    corpus = with_index(table(spark, sf_dir, "benchmark"), ["item_id"], "idx")
    size = corpus.count()
    rows = asked(spark, sf_dir).withColumn("idx", F.col("request") % size)
    return rows.join(corpus, "idx").select("request", "item_id", F.concat(F.lit("answer from shared context: "), "text").alias("prompt"))


def corpus_files(spark: SparkSession, nodes: int, files: int) -> DataFrame:
    """file, nodes and offset: an even split, the first files one longer, and the nodes before each."""
    base, rest = divmod(nodes, files)
    f = F.col("file")
    return spark.range(files).select(F.col("id").alias("file")).select("file", (base + (f < rest).cast("long")).alias("nodes"), (f * base + F.least(f, F.lit(rest))).alias("offset"))


@query("SELECT file, nodes, coalesce(sum(nodes) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset FROM (SELECT i AS file, n // 40 + CASE WHEN i < n % 40 THEN 1 ELSE 0 END AS nodes FROM (SELECT unnest(range(40)) AS i), (SELECT count(*) AS n FROM documents))".replace("AS offset", 'AS "offset"'))
def corpus_split(spark, sf_dir):
    """The documents dealt evenly to forty files."""
    return corpus_files(spark, table(spark, sf_dir, "documents").count(), 40)


@query("SELECT id AS node_id, array_to_string(list_transform(range(4), lambda i: md5('11/' || id || '/' || i)), '') AS text FROM (SELECT doc_id AS id FROM documents)")
def synthetic_nodes(spark, sf_dir):
    """Deterministic texts of 128 characters, one a document."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.md5(F.concat_ws("/", F.lit("11"), F.col("id").cast("string"), i.cast("string"))))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).select(F.col("id").alias("node_id"), F.array_join(parts, "").alias("text"))


@query("SELECT x::INT AS x FROM (SELECT unnest([greatest(1, try_cast(v AS INT)) for v in string_split('1,0,16,4', ',')]) AS x) UNION ALL SELECT unnest(range(2, 11, 4))::INT")
def parse_grid(spark, sf_dir):
    """'a,b,c' as numbers of at least 1, and 'start:end:step'."""
    listed = spark.range(1).select(F.explode(F.transform(F.split(F.lit("1,0,16,4"), ","), lambda v: F.greatest(F.lit(1), v.try_cast("int")))).alias("x"))
    return listed.union(spark.range(1).select(F.explode(F.sequence(F.lit(2), F.lit(10), F.lit(4)))))


def rate(text: Column) -> Column:
    """Bytes a second of '10 Gbps', '400Mbps', '5 GB/s', '20 MB/s'."""
    number = F.regexp_extract(text, r"([0-9.]+)", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(text, r"[0-9.]+\s*([A-Za-z/]+)", 1))
    return number * F.when(unit == "gbps", 1e9 / 8).when(unit == "mbps", 1e6 / 8).when(unit == "gb/s", 1e9).when(unit == "mb/s", 1e6).otherwise(1.0)


def seconds(text: Column) -> Column:
    """Seconds of '10us', '1.5 ms', '2s'."""
    number = F.regexp_extract(text, r"([0-9.]+)", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(text, r"[0-9.]+\s*([A-Za-z]+)", 1))
    return number * F.when(unit == "us", 1e-6).when(unit == "ms", 1e-3).otherwise(1.0)


@query("SELECT * FROM (VALUES ('10 Gbps', 1.25e9::DOUBLE, '10us', 1e-5::DOUBLE), ('400Mbps', 5e7::DOUBLE, '1.5 ms', 0.0015::DOUBLE), ('5 GB/s', 5e9::DOUBLE, '2s', 2.0::DOUBLE)) AS t(link, bytes_per_sec, delay, delay_sec)")
def parse_units(spark, sf_dir):
    rows = spark.sql("SELECT * FROM VALUES ('10 Gbps', '10us'), ('400Mbps', '1.5 ms'), ('5 GB/s', '2s') AS t(link, delay)")
    return rows.select("link", F.round(rate(F.col("link")), 3).alias("bytes_per_sec"), "delay", F.round(seconds(F.col("delay")), 9).alias("delay_sec"))
