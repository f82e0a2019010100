"""Queries over workflow graphs: templates, validation, topological levels."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import blank_words
from ..operators import graphs as G
from ..registry import query, table
from .states import WORDS

GRAPHS = {"linear": ("linear", 0, 0), "branching": ("branching", 3, 0), "tree": ("tree", 2, 2), "rag": ("rag", 2, 0)}
MADE = {g: G.template(*how) for g, how in GRAPHS.items()}
#: The templates by rule: branches 3, tree of 2 levels with 2 children, 2 agents; pos orders nodes as they are made.
TEMPLATE_NODES = """(SELECT 'linear' AS graph, unnest(['materialize_0', 'transfer_0', 'generate_0', 'evict_0']) AS node_id, unnest(['kv_materialize', 'kv_transfer', 'generate', 'kv_evict']) AS kind, unnest([0, 1, 2, 3]) AS pos, unnest([0, 1, 1, 1]) AS state_inputs
UNION ALL SELECT 'branching', unnest(['materialize_root', 'fork_root', 'merge_branches', 'evict_merged']), unnest(['kv_materialize', 'kv_fork', 'kv_merge', 'kv_evict']), unnest([0, 1, 8, 9]), unnest([0, 1, 3, 1])
UNION ALL SELECT 'branching', p || i, k, 2 + 2 * i + o, 1 FROM (SELECT unnest(range(3)) AS i), (VALUES ('transfer_branch_', 'kv_transfer', 0), ('generate_branch_', 'generate', 1)) AS t(p, k, o)
UNION ALL SELECT 'rag', unnest(['retrieve', 'materialize_context', 'fork_agents', 'merge_agent_answers', 'evict_rag']), unnest(['retrieve', 'kv_materialize', 'kv_fork', 'kv_merge', 'kv_evict']), unnest([0, 1, 2, 7, 8]), unnest([0, 0, 1, 2, 1])
UNION ALL SELECT 'rag', CASE WHEN o = 0 THEN 'transfer_agent_' || i ELSE 'agent_' || i || '_generate' END, k, 3 + 2 * i + o, 1 FROM (SELECT unnest(range(2)) AS i), (VALUES ('kv_transfer', 0), ('generate', 1)) AS t(k, o)
UNION ALL SELECT 'tree', unnest(['materialize_root', 'merge_thoughts', 'evict_final']), unnest(['kv_materialize', 'kv_merge', 'kv_evict']), unnest([0, 10, 11]), unnest([0, 4, 1])
UNION ALL SELECT 'tree', 'fork_l' || l || '_p' || p, 'kv_fork', CASE WHEN l = 0 THEN 1 ELSE 4 + 3 * p END, 1 FROM (VALUES (0, 0), (1, 0), (1, 1)) AS f(l, p)
UNION ALL SELECT 'tree', 'generate_l' || l || '_p' || p || '_b' || b, 'generate', CASE WHEN l = 0 THEN 2 + b ELSE 5 + 3 * p + b END, 1 FROM (VALUES (0, 0), (1, 0), (1, 1)) AS f(l, p), (SELECT unnest(range(2)) AS b)) AS n"""
#: Their edges by rule: (graph, source, target), each with its types.
TEMPLATE_LINKS = """(SELECT * FROM (VALUES ('linear', 'materialize_0', 'transfer_0', 'both'), ('linear', 'transfer_0', 'generate_0', 'both'), ('linear', 'generate_0', 'evict_0', 'state'),
('branching', 'materialize_root', 'fork_root', 'both'), ('branching', 'merge_branches', 'evict_merged', 'state'), ('rag', 'retrieve', 'materialize_context', 'data'), ('rag', 'materialize_context', 'fork_agents', 'both'), ('rag', 'merge_agent_answers', 'evict_rag', 'state'),
('tree', 'materialize_root', 'fork_l0_p0', 'both'), ('tree', 'generate_l0_p0_b0', 'fork_l1_p0', 'both'), ('tree', 'generate_l0_p0_b1', 'fork_l1_p1', 'both'), ('tree', 'merge_thoughts', 'evict_final', 'state')) AS v(graph, source, target, types)
UNION ALL SELECT 'branching', unnest(['fork_root', 'transfer_branch_' || i, 'generate_branch_' || i]), unnest(['transfer_branch_' || i, 'generate_branch_' || i, 'merge_branches']), 'both' FROM (SELECT unnest(range(3)) AS i)
UNION ALL SELECT 'rag', unnest(['fork_agents', 'transfer_agent_' || i, 'agent_' || i || '_generate']), unnest(['transfer_agent_' || i, 'agent_' || i || '_generate', 'merge_agent_answers']), 'both' FROM (SELECT unnest(range(2)) AS i)
UNION ALL SELECT 'tree', 'fork_l' || l || '_p' || p, 'generate_l' || l || '_p' || p || '_b' || b, 'both' FROM (VALUES (0, 0), (1, 0), (1, 1)) AS f(l, p), (SELECT unnest(range(2)) AS b)
UNION ALL SELECT 'tree', 'generate_l1_p' || p || '_b' || b, 'merge_thoughts', 'both' FROM (SELECT unnest(range(2)) AS p), (SELECT unnest(range(2)) AS b))"""
#: Each conversation runs one of them, on its words.
FLOWS = f"SELECT conv_id, {list(GRAPHS)}[conv_id % 4 + 1] AS graph, sum({WORDS})::BIGINT AS tokens FROM conversations GROUP BY conv_id"
NODES = f"(SELECT n.graph || '#' || c.conv_id AS graph, n.node_id, n.kind, n.pos, n.state_inputs, c.tokens FROM {TEMPLATE_NODES} JOIN ({FLOWS}) c ON c.graph = n.graph) AS n"
EDGES = f"(SELECT l.graph || '#' || c.conv_id AS graph, source, target, unnest(CASE types WHEN 'both' THEN ['state', 'data'] ELSE [types] END) AS edge_type FROM {TEMPLATE_LINKS} AS l JOIN ({FLOWS}) c ON c.graph = l.graph) AS e"


def flows(spark, sf_dir, made=None, *others: str):
    """Nodes (with the tokens of their run) and edges of each conversation's graph, and of the others named."""
    nodes, edges = G.frames(spark, made or MADE)  # a few templates
    own = F.element_at(F.array(*map(F.lit, GRAPHS)), (F.col("conv_id") % 4 + 1).cast("int"))
    runs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.size(blank_words(F.col("text")))).alias("tokens"))
    runs = runs.withColumn("graph", F.explode(F.array(own, *map(F.lit, others))))
    named = lambda c: F.concat(c, F.lit("#"), F.col("conv_id").cast("string"))
    nodes = runs.join(F.broadcast(nodes), "graph").withColumn("graph", named(F.col("graph"))).drop("conv_id")
    return nodes, runs.drop("tokens").join(F.broadcast(edges), "graph").withColumns({"graph": named(F.col("graph")), "edge_id": named(F.col("edge_id"))}).drop("conv_id")


@query(f"SELECT graph, node_id, kind, pos::INT AS pos, state_inputs::INT AS state_inputs FROM {NODES}")
def graph_templates(spark, sf_dir):
    return flows(spark, sf_dir)[0].drop("tokens")


@query(f"SELECT graph, source, target, edge_type FROM {EDGES}")
def graph_edges(spark, sf_dir):
    return flows(spark, sf_dir)[1].select("graph", "source", "target", "edge_type")


@query(f"SELECT graph, nodes, edges FROM (SELECT graph, string_agg(node_id || ':' || kind || ':' || state_inputs, ',' ORDER BY pos) AS nodes FROM {NODES} GROUP BY graph) JOIN (SELECT graph, string_agg(source || '>' || target || ':' || edge_type, ',' ORDER BY source, target, edge_type) AS edges FROM {EDGES} GROUP BY graph) USING (graph)")
def graph_json(spark, sf_dir):
    """Graphs written as JSON and read back, node by node and edge by edge."""
    nodes, edges = G.from_json(G.to_json(*flows(spark, sf_dir)))
    n = nodes.groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(":", "node_id", "kind", F.col("state_inputs").cast("string")).alias("t")))).alias("x"))
    e = edges.groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("source", "target", "edge_type"))).alias("y"))
    return n.join(e, "graph").select("graph", F.array_join(F.transform("x", lambda x: x["t"]), ",").alias("nodes"), F.array_join(F.transform("y", lambda y: F.concat(y["source"], F.lit(">"), y["target"], F.lit(":"), y["edge_type"])), ",").alias("edges"))


@query("SELECT 'bad#' || conv_id AS graph, problem, CASE problem WHEN 'repeated edge' THEN item || '#' || conv_id ELSE item END AS item FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES ('unknown node', 'x'), ('repeated node', 'a'), ('repeated edge', 'bad:e0'), ('cycle', 'c'), ('cycle', 'd')) AS p(problem, item)")
def graph_validate(spark, sf_dir):
    """Beside each conversation's sound graph one with a fault of each kind."""
    bad = ([("a", "m", 0), ("b", "g", 0), ("c", "g", 0), ("d", "g", 0), ("a", "m", 0)], [("a", "b", "state", "s"), ("c", "d", "state", "s"), ("d", "c", "state", "s"), ("b", "x", "data", "v")])
    nodes, edges = flows(spark, sf_dir, MADE | {"bad": bad}, "bad")
    return G.problems(nodes, edges.union(edges.where("edge_id LIKE 'bad:e0#%'")))


@query(f"""WITH RECURSIVE walk(graph, node_id, level) AS (SELECT graph, node_id, 0 FROM {NODES} WHERE NOT EXISTS (SELECT 1 FROM {EDGES} WHERE e.graph = n.graph AND e.target = n.node_id)
UNION ALL SELECT w.graph, e.target, w.level + 1 FROM walk w JOIN {EDGES} ON e.graph = w.graph AND e.source = w.node_id)
SELECT graph, node_id, max(level) AS level FROM walk GROUP BY 1, 2""")
def graph_levels(spark, sf_dir):
    return G.levels(*flows(spark, sf_dir))


@query(f"SELECT graph, string_agg(node_id, ',' ORDER BY level, pos) AS node_order, count(*) FILTER (WHERE kind = 'kv_transfer') AS transfers FROM (SELECT graph, node_id, max(level) AS level FROM (WITH RECURSIVE walk(graph, node_id, level) AS (SELECT graph, node_id, 0 FROM {NODES} WHERE NOT EXISTS (SELECT 1 FROM {EDGES} WHERE e.graph = n.graph AND e.target = n.node_id) UNION ALL SELECT w.graph, e.target, w.level + 1 FROM walk w JOIN {EDGES} ON e.graph = w.graph AND e.source = w.node_id) SELECT * FROM walk) GROUP BY 1, 2) JOIN {NODES} USING (graph, node_id) GROUP BY graph")
def graph_schedule(spark, sf_dir):
    """Order of execution (level, then place in the plan) and the transfers of each graph."""
    nodes, edges = flows(spark, sf_dir)
    rows = nodes.join(G.levels(nodes, edges), ["graph", "node_id"])
    order = F.array_sort(F.collect_list(F.struct("level", "pos", "node_id")))
    return rows.groupBy("graph").agg(F.array_join(F.transform(order, lambda x: x["node_id"]), ",").alias("node_order"), F.count_if(F.col("kind") == "kv_transfer").alias("transfers"))


COSTS = {"prefill": 2e-4, "bandwidth": 25e9, "latency": 5e-5, "decode": 5e-5, "resume": 1e-4, "omega_state": 5e-5}
RUN = f"""SELECT graph, row_number() OVER (PARTITION BY graph ORDER BY level, pos) - 1 AS seq, node_id, kind, CASE kind WHEN 'kv_materialize' THEN tokens * 0.0002 WHEN 'kv_transfer' THEN tokens * 512 / 25e9 + 0.00005 WHEN 'generate' THEN 8 * 0.00005 + 0.0001 WHEN 'kv_fork' THEN 0.00005 WHEN 'kv_merge' THEN 0.00005 ELSE 0 END AS seconds,
CASE WHEN kind IN ('kv_materialize', 'kv_transfer') THEN tokens * 512 ELSE 0 END AS bytes FROM {NODES} JOIN (SELECT graph, node_id, max(level) AS level FROM (WITH RECURSIVE walk(graph, node_id, level) AS (SELECT graph, node_id, 0 FROM {NODES} WHERE NOT EXISTS (SELECT 1 FROM {EDGES} WHERE e.graph = n.graph AND e.target = n.node_id) UNION ALL SELECT w.graph, e.target, w.level + 1 FROM walk w JOIN {EDGES} ON e.graph = w.graph AND e.source = w.node_id) SELECT * FROM walk) GROUP BY 1, 2) USING (graph, node_id)"""


def run_log(spark, sf_dir):
    return G.execute(*flows(spark, sf_dir), F.col("tokens"), 512, COSTS)


@query(f"SELECT graph, seq, node_id, kind, round(seconds, 9) AS seconds, bytes::BIGINT AS bytes FROM ({RUN})")
def graph_run(spark, sf_dir):
    """The event log of each graph's execution."""
    return run_log(spark, sf_dir).withColumn("seconds", F.round("seconds", 9))


@query(f"SELECT graph, round(sum(seconds), 9) AS total_sec, round(sum(seconds) FILTER (WHERE seq <= first), 9) AS ttft_sec, sum(bytes) FILTER (WHERE kind = 'kv_transfer')::BIGINT AS moved_bytes, count(*) FILTER (WHERE kind = 'generate') AS generated FROM (SELECT *, min(CASE WHEN kind = 'generate' THEN seq END) OVER (PARTITION BY graph) AS first FROM ({RUN})) GROUP BY graph")
def graph_run_summary(spark, sf_dir):
    """Totals of a run, and the time up to its first generated token."""
    first = F.min(F.when(F.col("kind") == "generate", F.col("seq"))).over(Window.partitionBy("graph"))
    rows = run_log(spark, sf_dir).withColumn("first", first)
    moved = F.sum(F.when(F.col("kind") == "kv_transfer", F.col("bytes")))
    return rows.groupBy("graph").agg(F.round(F.sum("seconds"), 9).alias("total_sec"), F.round(F.sum(F.when(F.col("seq") <= F.col("first"), F.col("seconds"))), 9).alias("ttft_sec"), moved.alias("moved_bytes"), F.count_if(F.col("kind") == "generate").alias("generated"))


@query(f"SELECT graph, edge_type, count(*) AS edges, string_agg(source || '>' || target, ',' ORDER BY source, target) AS resolved FROM {EDGES} GROUP BY 1, 2")
def graph_symbols(spark, sf_dir):
    """Symbols of edges resolved to the nodes that bind them: each symbol of a target is bound by its edge's source."""
    nodes, edges = flows(spark, sf_dir)
    bound = edges.join(nodes.select("graph", F.col("node_id").alias("source")), ["graph", "source"])
    pairs = F.array_sort(F.collect_list(F.struct("source", "target")))
    return bound.groupBy("graph", "edge_type").agg(F.count("*").alias("edges"), F.array_join(F.transform(pairs, lambda p: F.concat_ws(">", p["source"], p["target"])), ",").alias("resolved"))


@query("""WITH RECURSIVE best AS MATERIALIZED (SELECT conv_id, max(turn) AS n FROM conversations GROUP BY conv_id), walk(conv_id, turn) AS (SELECT conv_id, 0::BIGINT FROM best UNION ALL SELECT w.conv_id, w.turn + 1 FROM walk w JOIN best USING (conv_id) WHERE w.turn < n)
SELECT conv_id, count(*) AS depth FROM walk GROUP BY conv_id""")
def recursive_depth(spark, sf_dir):
    """Reply chains walked by a recursive query."""
    table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("n")).createOrReplaceTempView("sparloom_chains")
    return spark.sql("WITH RECURSIVE walk(conv_id, turn, n) AS (SELECT conv_id, 0L, n FROM sparloom_chains UNION ALL SELECT conv_id, turn + 1, n FROM walk WHERE turn < n) SELECT conv_id, count(*) AS depth FROM walk GROUP BY conv_id")
