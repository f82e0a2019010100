"""Queries over event time: windows in batch form, and streams that must agree with them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..registry import query, table
from ..streaming import windows as S


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_1h(spark, sf_dir):
    return S.tumbling(table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT start, count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS start FROM events UNION ALL SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR FROM events) GROUP BY start")
def sliding_2h(spark, sf_dir):
    return S.sliding(table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
(SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def sessions_30m(spark, sf_dir):
    out = S.sessions(table(spark, sf_dir, "events"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "last")})


@query("SELECT event_id, user_id FROM (SELECT *, max(ts) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS mark FROM events) WHERE ts >= mark - INTERVAL 1 HOUR".replace("max(ts) OVER (ORDER BY", "max(ts) OVER (PARTITION BY user_id ORDER BY"))
def late_drop(spark, sf_dir):
    """Events no more than an hour behind the latest seen of their user."""
    from pyspark.sql.window import Window

    mark = F.max("ts").over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return table(spark, sf_dir, "events").withColumn("mark", mark).where(F.col("ts") >= F.col("mark") - F.expr("INTERVAL 1 HOUR")).select("event_id", "user_id")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_totals(spark, sf_dir):
    """Running totals of a file stream, complete mode, by the available-now trigger."""
    rows = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(rows.schema).parquet(f"{sf_dir}/events.parquet*")
    totals = stream.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    name = "totals_" + uuid.uuid4().hex
    job = totals.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.table(name)
