"""Prefix trie of conversations, built as a Patricia tree.

A turn is the 128-bit digest of its role and text, a conversation the sequence of
its turns' digests, in bytes.  Sequences are sorted by ranges; in a range only the
points where sequences branch, end or are leaves are made, joined by compressed
edges, and aggregates are computed on these points; unary nodes are then expanded
along their edges with suffix sums of words.

Nodes that a range may share with its neighbours all lie on the paths of its first
and its last sequence.  These, the spine, are left open: each range tells what hangs
below each of them, and one pass over the spine in order of ranges, which holds one
path at a time, adds the parts up.  The spine has two paths a range, whatever the
rows.  Children of spine nodes meet their parent's name by a join on its digest.

Alike conversations, however many, are one row a range before they are shuffled
again; a range holds about RANGE_BYTES of sequences.  A conversation's turns bound a
row: 20 bytes a turn; no text is shuffled.

Defined cases: rows without conv_id belong to no conversation; turns without number
come first, turns of equal number by the digest of role and text (MD5, hex), and
repeated rows are turns each; a null role or text is empty; a conversation left
without turns ends at the root; an empty table has no node; other columns take no
part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, n_words, read_table
from .merkle import CRC

#: Bytes of a turn's digest; bytes of sequences that a range is meant to hold; conversations named by a row of a run.
UNIT, RANGE_BYTES, RUN = 16, 8 << 20, 5_000
#: Spine nodes up to which their table is broadcast; more are joined.
MOST_SPINE = 100_000

NODE = "depth long, key binary, up binary, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
FIELDS = [f.split()[0] for f in NODE.split(", ")]
NOTHING = hashlib.sha256().hexdigest()


# ---------------------------------------------------------------- conversations


def sequences(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turns: array of (turn, unit, words) in order) of each conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    unit = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))  # no text shows another role
    rows = turns.where(F.col("conv_id").isNotNull()).select("conv_id", F.struct("turn", unit.alias("unit"), n_words(text).cast("int").alias("words")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(turns: DataFrame, head: Column, base: Column, most: int) -> DataFrame:
    """Rows (conv_id, units binary, words array<int>): the first `head` turns of conversation `base`, then the own ones after as many.

    head and base are columns over conv_id; head is at most `most`.
    """
    own = materialize(sequences(turns), "trie-own")
    heads = own.select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most).alias("_head"))
    met = own.withColumn("_h", head).join(heads, base == F.col("_base"), "left")  # a base has as many rows as conversations share it
    begun = F.coalesce(F.slice("_head", F.lit(1), F.col("_h")), F.slice("turns", 1, 0))
    both = met.select("conv_id", F.concat(begun, F.expr("slice(turns, _h + 1, greatest(size(turns) - _h, 0))")).alias("turns"))
    return both.select("conv_id", F.unhex(F.array_join("turns.unit", "")).alias("units"), F.col("turns.words").alias("words"))


# -------------------------------------------------------------------- the ranges


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (units, conv_id): one row for each RUN alike sequences that follow each other."""
    held: tuple[bytes, list[int], list[int]] | None = None

    def ready(runs: list[tuple[bytes, list[int], list[int]]]) -> pa.RecordBatch:
        units, words, ids = zip(*runs, strict=True)
        shown = [",".join(map(str, i)) for i in ids]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((units, words, [i[0] for i in ids], list(map(len, ids)), shown), RUNS, strict=True)], schema=RUNS)

    for b in batches:
        done = []
        for units, words, conv in zip(*(b.column(c).to_pylist() for c in ("units", "words", "conv_id")), strict=True):
            if held and held[0] == units and len(held[2]) < RUN:
                held[2].append(conv)
                continue
            if held:
                done.append(held)
            held = units, words, [conv]
        if done:
            yield ready(done)
    if held:
        yield ready([held])


RUNS = pa.schema([("units", pa.binary()), ("words", pa.list_(pa.int32())), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])


def shared(a: bytes, b: bytes) -> int:
    """Turns with which both sequences begin."""
    n = min(len(a), len(b)) // UNIT
    if a[: n * UNIT] == b[: n * UNIT]:
        return n
    x, y = (np.frombuffer(s, np.uint8, n * UNIT) for s in (a, b))
    return int(np.argmax(x != y)) // UNIT


class Range:
    """Distinct sequences of one range, in order, and the points of their compressed tree."""

    def __init__(self) -> None:
        self.units: list[bytes] = []
        self.sums: list[np.ndarray] = []  # words of the first d turns, by d
        self.tells: list[tuple[int, int, str]] = []  # conversations, the least one, digest of all

    def add(self, units: bytes, words: list[int], n: int, least: int, sha: str) -> None:
        self.units.append(units)
        self.sums.append(np.concatenate(([0], np.cumsum(words, dtype=np.int64))))
        self.tells.append((n, least, sha))

    def key(self, row: int, depth: int) -> bytes:
        return hashlib.md5(self.units[row][: depth * UNIT]).digest()

    def tree(self) -> tuple[list[tuple], dict[tuple[bool, int], list]]:
        """Edges of inner points, and what hangs at spine nodes.

        An edge: (row, depth above, depth, number of the point above or -1, n,
        least, children, leaves, saved, digest of ends, its number).  A spine
        node, by (is on the first path, depth): [n, least, children, leaves,
        saved, digest of ends].
        """
        deep = [len(u) // UNIT for u in self.units]
        first, last, end = deep[0], deep[-1], len(deep) - 1
        edges: list[tuple] = []
        spine: dict[tuple[bool, int], list] = {}
        # an open point: depth, first row below, n, least, children, leaves, saved, digest of ends, number
        stack: list[list] = [[0, 0, 0, None, 0, 0, 0, None, 0]]
        made = 1

        def hang(low: int, depth: int, n: int, least: int | None, kids: int, leaves: int, saved: int, ends: str | None) -> None:
            part = spine.setdefault((low == 0, depth), [0, None, 0, 0, 0, None])
            part[0] += n
            part[1] = least if part[1] is None else part[1] if least is None else min(part[1], least)
            part[2] += kids
            part[3] += leaves
            part[4] += saved
            part[5] = part[5] or ends

        def close(above: int, high: int) -> None:
            """Closes points deeper than `above`; rows up to `high` are below them."""
            nonlocal made
            while stack[-1][0] > above:
                depth, low, n, least, kids, leaves, saved, ends, number = stack.pop()
                if stack[-1][0] < above:
                    stack.append([above, low, 0, None, 0, 0, 0, None, made])
                    made += 1
                parent = stack[-1]
                open_ = max(first if low == 0 else 0, last if high == end else 0)
                if depth <= open_:  # a spine node itself: all its edge is
                    hang(low, depth, n, least, kids, leaves, saved, ends)
                    continue
                leaves = leaves or 1
                top = max(parent[0], open_)
                edges.append((low, top, depth, parent[8] if top == parent[0] else -1, n, least, kids, leaves, saved, ends, number))
                saved += (n - 1) * int(self.sums[low][depth] - self.sums[low][top])
                if top > parent[0]:
                    hang(low, top, n, least, 1, leaves, saved, None)
                else:
                    parent[2] += n
                    parent[3] = least if parent[3] is None else min(parent[3], least)
                    parent[4] += 1
                    parent[5] += leaves
                    parent[6] += saved

        for i, (n, least, sha) in enumerate(self.tells):
            if i:
                close(shared(self.units[i - 1], self.units[i]), i - 1)
            if deep[i] == stack[-1][0]:  # the root, without turns
                stack[-1][2:4], stack[-1][7] = [n, least], sha
            else:
                stack.append([deep[i], i, n, least, 0, 0, 0, sha, made])
                made += 1
        close(0, end)
        root = stack[0]
        hang(0, 0, *root[2:8])
        return edges, spine

    def nodes(self, edges: list[tuple]) -> pa.RecordBatch:
        """Inner nodes, expanded: key null, up null where the parent is an inner one."""
        if not edges:
            return pa.RecordBatch.from_pydict({f: [] for f in FIELDS}, ARROW)
        row, top, depth, above, n, least, kids, leaves, saved, _, number = (np.array(x, np.int64) for x in zip(*[(*e[:9], 0, e[10]) for e in edges], strict=True))
        ends = [e[9] or NOTHING for e in edges]
        name = np.full(int(max(number.max(), above.max())) + 2, -1, np.int64)  # a spine point has no edge; the last place is for -1
        name[number] = np.arange(len(edges))
        parent = name[above]
        size = depth - top
        edge = np.repeat(np.arange(len(edges)), size)
        at = np.arange(len(edge)) - np.repeat(np.cumsum(size) - size, size) + top[edge] + 1  # each node's depth
        sums, begin = np.concatenate(self.sums), np.cumsum([0, *map(len, self.sums)])
        low = begin[row[edge]]
        below = sums[low + depth[edge]] - sums[low + at - 1]  # suffix sums: words of the node's turn and those below it on the edge
        is_point, is_top = at == depth[edge], at == top[edge] + 1
        inner = is_top & (parent[edge] >= 0)
        up: list[bytes | None] = [None] * len(edge)
        for i in np.flatnonzero(is_top & (parent[edge] < 0)):
            up[i] = self.key(int(row[edge[i]]), int(top[edge[i]]))
        names = np.where(inner, least[parent[edge]], least[edge])
        return pa.RecordBatch.from_arrays([
            pa.array(at), pa.nulls(len(edge), pa.binary()), pa.array(up, pa.binary()), pa.array(least[edge]), pa.array(names),
            pa.array(n[edge]), pa.array(np.where(is_point, kids[edge], 1)), pa.array(leaves[edge]), pa.array(saved[edge] + (n[edge] - 1) * below),
            pa.array([ends[e] if p else NOTHING for e, p in zip(edge, is_point, strict=True)], pa.string()),
        ], schema=ARROW)

    def paths(self, spine: dict[tuple[bool, int], list]) -> Iterator[tuple]:
        """Spine nodes in order: (depth, key, words of the last turn, n, least, children, leaves, saved, digest of ends)."""
        last = len(self.units) - 1
        same = shared(self.units[0], self.units[-1])
        for row, depths in ((0, range(len(self.units[0]) // UNIT + 1)), (last, range(same + 1, len(self.units[-1]) // UNIT + 1))):
            for d in depths:
                part = spine.get((row == 0, d), [0, None, 0, 0, 0, None])
                yield (d, self.key(row, d), int(self.sums[row][d] - self.sums[row][d - 1]) if d else 0, *part)


ARROW = pa.schema([pa.field(n, {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[k]) for n, k in (f.split() for f in NODE.split(", "))])
#: A range's rows: inner nodes (part -1) and spine nodes (place of the range, place there, words of the turn).
ROWS = "part long, seq long, words long, " + NODE


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of runs sorted by (units, first): inner nodes and spine rows of the range."""
    found, part = Range(), 0
    at: list | None = None  # units, words, n, least, digest so far

    def done() -> None:
        if at:
            found.add(at[0], at[1], at[2], at[3], at[4].hexdigest())

    for b in batches:
        for p, units, words, first, n, ids in zip(*(b.column(c).to_pylist() for c in ("part", "units", "words", "first", "n", "ids")), strict=True):
            part = p
            if at and at[0] == units:
                at[2] += n
                at[4].update(b"," + ids.encode())
            else:
                done()
                at = [units, words, n, first, hashlib.sha256(ids.encode())]
    done()
    if not found.units:
        return
    edges, spine = found.tree()
    inner = found.nodes(edges)
    for i in range(0, inner.num_rows, 10_000):
        piece = inner.slice(i, 10_000)
        fill = [pa.array(np.full(piece.num_rows, v)) for v in (-1, 0, 0)]
        yield pa.RecordBatch.from_arrays([*fill, *piece.columns], ["part", "seq", "words", *FIELDS])
    rows = [(part, i, words, d, key, None, least, None, n, kids, leaves, saved, ends) for i, (d, key, words, n, least, kids, leaves, saved, ends) in enumerate(found.paths(spine))]
    schema = pa.schema([*(pa.field(x, pa.int64()) for x in ("part", "seq", "words")), *ARROW])
    for i in range(0, len(rows), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 10_000], strict=True), schema, strict=True)], schema=schema)


def _spine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of spine rows in order of ranges: finished spine nodes.  Holds one path."""
    # an open node: key, words, n, least, children, leaves, saved, digest of ends
    stack: list[list] = []
    out: list[tuple] = []

    def close(depth: int) -> None:
        while len(stack) > depth:
            key, words, n, least, kids, leaves, saved, ends = stack.pop()
            leaves, saved = leaves if kids else 1, saved + (n - 1) * words
            parent = stack[-1] if stack else None
            out.append((len(stack), key, parent and parent[0], least, None, n, kids, leaves, saved, ends or NOTHING))
            if parent:
                parent[2] += n
                parent[3] = least if parent[3] is None else min(parent[3], least)
                parent[4] += 1
                parent[5] += leaves
                parent[6] += saved

    def ready() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), ARROW, strict=True)], schema=ARROW)
        out.clear()
        return made

    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("depth", "key", "words", "n_convs", "conv_id", "n_children", "n_leaves", "saved_tokens", "ends_sha256")), strict=True):
            depth, key, words, n, least, kids, leaves, saved, ends = row
            if depth < len(stack) and stack[depth][0] == key:
                node = stack[depth]
                node[2] += n
                node[3] = least if node[3] is None else node[3] if least is None else min(node[3], least)
                node[4] += kids
                node[5] += leaves
                node[6] += saved
                node[7] = node[7] or ends
            else:
                close(depth)
                stack.append([key, words, n, least, kids, leaves, saved, ends])
        if len(out) > 5_000:
            yield ready()
    close(0)
    if out:
        yield ready()


# --------------------------------------------------------------------- the trie


def trie(convs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Nodes of the trie of (conv_id, units, words): NODE without keys.

    conv_id is the least member; depth its turns; n_convs members; n_children and
    n_leaves as named; saved_tokens sums (n_convs - 1) times the words of the last
    turn over the node's subtree; ends_sha256 digests the ids that end there.
    """
    spark = convs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = convs.repartitionByRange(parts, "units", "conv_id").sortWithinPartitions("units", "conv_id")
    runs = materialize(ordered.mapInArrow(_runs, "units binary, words array<int>, first long, n long, ids string"), "trie-runs")
    total = runs.agg(F.sum(F.octet_length("units") + 4 * F.size("words"))).first()[0] or 0
    ranges = max(1, -(-total // range_bytes))
    dealt = runs.repartitionByRange(ranges, "units").sortWithinPartitions("units", "first").withColumn("part", F.spark_partition_id().cast("long"))
    built = materialize(dealt.mapInArrow(_ranges, ROWS), "trie-ranges")
    discard(runs)
    open_ = built.where("part >= 0").repartition(1).sortWithinPartitions("part", "seq")  # two paths a range
    spine = materialize(open_.mapInArrow(_spine, NODE), "trie-spine")
    names = spine.select(F.col("key").alias("_up"), F.col("conv_id").alias("_name"))
    names = F.broadcast(names) if names.count() <= MOST_SPINE else names  # checked
    inner = built.where("part < 0")
    hung = inner.where("up IS NOT NULL").unionByName(spine, allowMissingColumns=True).join(names, F.col("up") == F.col("_up"), "left").withColumn("parent_conv_id", F.col("_name"))
    shown = [f for f in FIELDS if f not in ("key", "up")]
    return inner.where("up IS NULL").select(*shown).union(hung.select(*shown))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    conv = F.col("conv_id")
    found = rebuilt(turns, (F.crc32(conv.cast("string")) % 4).cast("int"), conv - conv % 20, 3)
    return trie(found).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


SQL = f"""WITH own AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, u) AS p, u, w FROM
  (SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS u, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS w FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (SELECT c, {CRC.format('c::VARCHAR')} % 4 AS h, c - c % 20 AS b FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL)),
turns AS (SELECT v.c, o.p, o.u, o.w FROM convs v JOIN own o ON o.c = v.b AND o.p <= v.h UNION ALL SELECT v.c, o.p + 1000, o.u, o.w FROM convs v JOIN own o ON o.c = v.c AND o.p > v.h),
paths AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY p) AS d, w, string_agg(u, '') OVER (PARTITION BY c ORDER BY p) AS k FROM turns UNION ALL SELECT c, 0, 0, '' FROM convs),
deep AS (SELECT c, max(d) AS most FROM paths GROUP BY c),
nodes AS (SELECT d, k, min(c) AS conv_id, count(*) AS n, any_value(w) AS w, sha256(coalesce(string_agg(CASE WHEN d = most THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends FROM paths JOIN deep USING (c) GROUP BY d, k),
kids AS (SELECT substr(k, 1, 32 * (d - 1)) AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
full_ AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (k)),
sums AS (SELECT substr(k, 1, 32 * a) AS k, sum((n - 1) * w)::BIGINT AS saved, count(*) FILTER (n_children = 0) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM full_) GROUP BY 1)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, f.ends AS ends_sha256
FROM full_ f JOIN sums s USING (k) LEFT JOIN nodes p ON f.d > 0 AND p.k = substr(f.k, 1, 32 * (f.d - 1))"""
