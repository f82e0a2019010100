"""Relational breadth on the star schema: every kind of join, grouping, set and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..registry import query, table


def t(spark, sf_dir, *names):
    out = [table(spark, sf_dir, n) for n in names]
    return out if len(out) > 1 else out[0]


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def join_star(spark, sf_dir):
    o, c, n, r = t(spark, sf_dir, "orders", "customer", "nation", "region")
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return rows.groupBy("r_name", "n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_semi(spark, sf_dir):
    c, o = t(spark, sf_dir, "customer", "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, sf_dir):
    c, o = t(spark, sf_dir, "customer", "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_name")


@query("SELECT coalesce(p_partkey, s_suppkey) AS key, p_brand, s_name FROM part FULL JOIN supplier ON p_partkey = s_suppkey + 50")
def join_full_outer(spark, sf_dir):
    p, s = t(spark, sf_dir, "part", "supplier")
    return p.join(s, p.p_partkey == s.s_suppkey + 50, "full_outer").select(F.coalesce("p_partkey", "s_suppkey").alias("key"), "p_brand", "s_name")


@query("SELECT o_orderkey, max(event_id) AS event_id, max(ts) AS event_ts FROM (SELECT * FROM orders ASOF JOIN (SELECT event_id, ts, user_id, ts AS at FROM events) e ON o_custkey = e.user_id AND o_orderdate + INTERVAL 30 YEAR >= e.at) GROUP BY 1")
def join_asof(spark, sf_dir):
    """Each order's latest event of the same user before a moved date: union, then a running last value."""
    o, e = t(spark, sf_dir, "orders", "events")
    none = F.lit(None)
    left = o.select(F.col("o_custkey").alias("k"), (F.col("o_orderdate") + F.expr("INTERVAL 30 YEAR")).alias("at"), F.lit(1).alias("side"), F.col("o_orderkey"), none.cast("long").alias("event_id"), none.cast("timestamp_ntz").alias("ts"))
    right = e.select(F.col("user_id").alias("k"), F.col("ts").alias("at"), F.lit(0).alias("side"), none.cast("long").alias("o_orderkey"), "event_id", "ts")
    so_far = Window.partitionBy("k").orderBy("at", "side", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = left.union(right).withColumn("e", F.last(F.when(F.col("side") == 0, F.struct("event_id", "ts")), ignorenulls=True).over(so_far))
    return found.where("side = 1 AND e IS NOT NULL").select("o_orderkey", F.col("e.event_id").alias("event_id"), F.col("e.ts").alias("event_ts"))


@query("SELECT band, count(*) AS parts FROM part JOIN (VALUES ('small', 0, 10), ('medium', 10, 30), ('large', 30, 1000)) AS b(band, lo, hi) ON p_size >= lo AND p_size < hi GROUP BY band")
def join_range(spark, sf_dir):
    bands = spark.sql("SELECT * FROM VALUES ('small', 0, 10), ('medium', 10, 30), ('large', 30, 1000) AS b(band, lo, hi)")
    return t(spark, sf_dir, "part").join(F.broadcast(bands), (F.col("p_size") >= F.col("lo")) & (F.col("p_size") < F.col("hi"))).groupBy("band").agg(F.count("*").alias("parts"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def group_cube(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def group_rollup(spark, sf_dir):
    return t(spark, sf_dir, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT l_shipmode_year, A, N, R FROM (SELECT year(l_shipdate) AS l_shipmode_year, count(*) FILTER (WHERE l_returnflag = 'A') AS A, count(*) FILTER (WHERE l_returnflag = 'N') AS N, count(*) FILTER (WHERE l_returnflag = 'R') AS R FROM lineitem GROUP BY 1)")
def group_pivot(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").withColumn("l_shipmode_year", F.year("l_shipdate"))
    return rows.groupBy("l_shipmode_year").pivot("l_returnflag", ["A", "N", "R"]).count().fillna(0)


@query("SELECT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_except(spark, sf_dir):
    c, s = t(spark, sf_dir, "customer", "supplier")
    return c.select(F.col("c_nationkey").alias("nation")).subtract(s.where("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, sf_dir):
    c, s = t(spark, sf_dir, "customer", "supplier")
    return c.select(F.col("c_nationkey").alias("nation")).intersect(s.select("s_nationkey"))


@query("SELECT c_custkey AS key, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier")
def set_union_all(spark, sf_dir):
    c, s = t(spark, sf_dir, "customer", "supplier")
    return c.select(F.col("c_custkey").alias("key"), F.lit("customer").alias("kind")).unionByName(s.select(F.col("s_suppkey").alias("key"), F.lit("supplier").alias("kind")))


@query("SELECT c_mktsegment, c_custkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 5")
def topk_per_group(spark, sf_dir):
    best = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return t(spark, sf_dir, "customer").withColumn("rank", F.row_number().over(best)).where("rank <= 5").select("c_mktsegment", "c_custkey", "rank")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk_global(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER w, 2) AS running, lag(o_orderkey) OVER w AS prev FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)")
def window_running(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    running = F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), 2)
    return t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", running.alias("running"), F.lag("o_orderkey").over(w).alias("prev"))


@query("SELECT count(*) AS n, abs(count(DISTINCT o_custkey) - count(DISTINCT o_custkey)) <= 0.05 * count(*) AS close FROM orders")
def approx_distinct(spark, sf_dir):
    """An approximate count beside the exact one: only their agreement is reported.

    Both are taken over one row a customer, so that no customer carries a sketch of its own.
    """
    each = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    n = F.coalesce(F.sum("n"), F.lit(0))
    near = F.abs(F.approx_count_distinct("o_custkey", 0.02) - F.count("o_custkey")) <= 0.05 * n
    return each.agg(n.alias("n"), near.alias("close"))
