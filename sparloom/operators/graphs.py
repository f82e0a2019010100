"""Workflow graphs as two frames: nodes (graph, node_id, kind, pos) and edges (graph, edge_id, source, target, edge_type)."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut


Template = tuple[list[tuple[str, str, int]], list[tuple[str, str, str, str]]]


def template(name: str, size: int = 2, branch: int = 2) -> Template:
    """Nodes (id, kind, state inputs) and edges (source, target, type, symbol) of a workflow of this name.

    linear; branching (size branches); tree (size levels, branch children); rag (size agents).
    State edges carry a state's symbol, data edges a value's.
    """
    nodes: list[tuple[str, str, int]] = []
    edges: list[tuple[str, str, str, str]] = []
    size, branch = max(1, size), max(1, branch)

    def node(id_: str, kind: str, states: int = 0) -> str:
        nodes.append((id_, kind, states))
        return id_

    def link(a: str, b: str, state: str | None = None, value: str | None = None) -> None:
        for kind, symbol in (("state", state), ("data", value)):
            if symbol:
                edges.append((a, b, kind, symbol))

    def fan(root: str, of: str, ends: list[tuple[str, str]], merge: str, evict: str, final: str) -> None:
        """Transfer and generate nodes (ids in ends) behind a fork, joined by a merge."""
        for i, (sent, made) in enumerate(ends):
            link(root, node(sent, "kv_transfer", 1), f"kv_{of}_{i}", f"{of}_prompt_{i}")
            link(sent, node(made, "generate", 1), f"kv_{of}_remote_{i}", f"{of}_remote_prompt_{i}")
        node(merge, "kv_merge", len(ends))
        for i, (_, made) in enumerate(ends):
            link(made, merge, f"kv_{of}_remote_{i}", f"{of}_answer_{i}")
        link(merge, node(evict, "kv_evict", 1), final)

    if name == "linear":
        link(node("materialize_0", "kv_materialize"), node("transfer_0", "kv_transfer", 1), "kv_0", "prompt_tokens")
        link("transfer_0", node("generate_0", "generate", 1), "kv_1", "remote_prompt_tokens")
        link("generate_0", node("evict_0", "kv_evict", 1), "kv_1")
    elif name == "branching":
        link(node("materialize_root", "kv_materialize"), node("fork_root", "kv_fork", 1), "kv_root", "root_prompt")
        fan("fork_root", "branch", [(f"transfer_branch_{i}", f"generate_branch_{i}") for i in range(size)], "merge_branches", "evict_merged", "kv_merged")
    elif name == "rag":
        link(node("retrieve", "retrieve"), node("materialize_context", "kv_materialize"), None, "retrieved_context")
        link("materialize_context", node("fork_agents", "kv_fork", 1), "kv_context", "context_prompt")
        fan("fork_agents", "agent", [(f"transfer_agent_{i}", f"agent_{i}_generate") for i in range(size)], "merge_agent_answers", "evict_rag", "kv_rag_answer")
    elif name == "tree":
        level = [(node("materialize_root", "kv_materialize"), "kv_root", "thought_root")]
        for depth in range(size):
            below = []
            for p, (parent, state, value) in enumerate(level):
                fork = node(f"fork_l{depth}_p{p}", "kv_fork", 1)
                link(parent, fork, state, value)
                for b in range(branch):
                    at = f"l{depth}_p{p}_b{b}"
                    link(fork, node(f"generate_{at}", "generate", 1), f"kv_{at}", f"thought_{at}")
                    below.append((f"generate_{at}", f"kv_{at}", f"thought_{at}_out"))
            level = below
        node("merge_thoughts", "kv_merge", len(level))
        for made, state, value in level:
            link(made, "merge_thoughts", state, value)
        link("merge_thoughts", node("evict_final", "kv_evict", 1), "kv_final")
    else:
        raise ValueError(f"no workflow named {name}")
    return nodes, edges


def frames(spark: SparkSession, graphs: dict[str, tuple[list, list]]) -> tuple[DataFrame, DataFrame]:
    """The two frames of plan-sized graphs."""
    nodes = [(g, n, k, i, s) for g, (ns, _) in graphs.items() for i, (n, k, s) in enumerate(ns)]
    edges = [(g, f"{g}:e{i}", *e) for g, (_, es) in graphs.items() for i, e in enumerate(es)]
    return spark.createDataFrame(nodes, "graph string, node_id string, kind string, pos int, state_inputs int"), spark.createDataFrame(edges, "graph string, edge_id string, source string, target string, edge_type string, symbol string")


def problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, problem, item): unknown endpoints, repeated ids, and nodes on or behind a cycle."""
    lost = edges.select("graph", F.explode(F.array("source", "target")).alias("node_id")).join(nodes, ["graph", "node_id"], "left_anti")
    twice = nodes.groupBy("graph", "node_id").count().where("count > 1")
    edge_twice = edges.groupBy("graph", "edge_id").count().where("count > 1")
    out = lost.distinct().select("graph", F.lit("unknown node").alias("problem"), F.col("node_id").alias("item"))
    out = out.union(twice.select("graph", F.lit("repeated node"), "node_id")).union(edge_twice.select("graph", F.lit("repeated edge"), "edge_id"))
    placed = levels(nodes, edges)
    behind = nodes.select("graph", "node_id").distinct().join(placed, ["graph", "node_id"], "left_anti")
    return out.union(behind.select("graph", F.lit("cycle"), "node_id"))


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, node_id, level): the longest path from a start; nodes on or behind a cycle have none.

    Layers peel off: a node is placed once all its predecessors are.  Each round
    is a join; rounds end when no node is left without an unplaced predecessor,
    at the latest after as many as there are nodes.
    """
    left = cut(nodes.select("graph", "node_id").distinct())
    links = cut(edges.select("graph", "source", "target").distinct())
    done = None
    for level in itertools.count():
        blocked = links.join(left.withColumnRenamed("node_id", "source"), ["graph", "source"], "left_semi").select("graph", F.col("target").alias("node_id")).distinct()
        ready = cut(left.join(blocked, ["graph", "node_id"], "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            break
        done = ready if done is None else done.union(ready)
        left = cut(left.join(ready, ["graph", "node_id"], "left_anti"))
    return done if done is not None else nodes.select("graph", "node_id", F.lit(0).alias("level")).limit(0)


def to_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, body): each graph as one JSON object of its nodes and edges in order."""
    n = nodes.groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id", "kind", "state_inputs"))).alias("nodes"))
    e = edges.groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("edge_id", "source", "target", "edge_type", "symbol"))).alias("edges"))
    return n.join(e, "graph", "left").select("graph", F.to_json(F.struct("graph", "nodes", "edges")).alias("body"))


def from_json(graphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two frames of (body) rows; the inverse of to_json()."""
    kind = "graph string, nodes array<struct<pos:int,node_id:string,kind:string,state_inputs:int>>, edges array<struct<edge_id:string,source:string,target:string,edge_type:string,symbol:string>>"
    read = graphs.select(F.from_json("body", kind).alias("g")).select("g.*")
    nodes = read.select("graph", F.explode("nodes").alias("n")).select("graph", "n.node_id", "n.kind", "n.pos", "n.state_inputs")
    return nodes, read.select("graph", F.explode("edges").alias("e")).select("graph", "e.edge_id", "e.source", "e.target", "e.edge_type", "e.symbol")


def node_cost(kind: Column, tokens: Column, nbytes: Column, cost: dict[str, float], decode_tokens: int) -> Column:
    """Seconds of a node of this kind; kinds that are not named take none."""
    made = F.when(kind == "kv_materialize", tokens * cost["prefill"]).when(kind == "kv_transfer", nbytes / cost["bandwidth"] + cost["latency"])
    return made.when(kind == "generate", F.lit(decode_tokens * cost["decode"] + cost["resume"])).when(kind.isin("kv_fork", "kv_merge"), F.lit(cost["omega_state"])).otherwise(F.lit(0.0))


def execute(nodes: DataFrame, edges: DataFrame, tokens: Column, bytes_per_token: int, cost: dict[str, float], decode_tokens: int = 8) -> DataFrame:
    """A run's event log (graph, seq, node_id, kind, seconds, bytes): nodes in order of levels, costs by kind.

    Transfers move the state that is bound to them; a transferred, forked or merged
    state has the bytes of what it came from.
    """
    rows = nodes.join(levels(nodes, edges), ["graph", "node_id"])
    seq = F.row_number().over(Window.partitionBy("graph").orderBy("level", "pos")) - 1
    nbytes = tokens * bytes_per_token
    moved = F.when(F.col("kind") == "kv_transfer", nbytes).when(F.col("kind") == "kv_materialize", nbytes).otherwise(F.lit(0))
    return rows.select("graph", seq.alias("seq"), "node_id", "kind", node_cost(F.col("kind"), tokens, nbytes, cost, decode_tokens).alias("seconds"), moved.cast("long").alias("bytes"))
