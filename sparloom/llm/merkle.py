"""Merkle manifest of a dataset: one root that every row can be proved against.

A leaf is the digest of a row's fields.  The leaves of a group, in order of keys,
are the lowest level of its tree; every ARITY consecutive nodes have a parent,
their joined digests' digest, until one node is left, the group's subroot.  The
subroots, in order of groups, form a tree of the same kind up to the root.

The trees are built bottom up.  A written level spans SPAN levels of the tree: its
rows are runs of ARITY^SPAN sibling leaves of a subtree with their digests, so a
table of n leaves is n/32 rows, and a level is one exchange of these.  Proofs are
pushed top down: a level's rows join the proofs that their parents inherited, and
each child prepends its own siblings.  A row holds at most ARITY^SPAN digests
whatever a group's size; a group's leaves are dealt by runs, so one that holds most
rows spreads over all tasks.

A proof is a list of (left, right), level by level from the leaf up: the digests of
the run's other members on either side, joined as hex text.

Defined cases: a null field is shown as `-`; rows without key come first, rows of
equal keys by their leaves, and alike rows are leaves each; a null group is a group,
the first one; an empty table has no leaf and no root; columns that are not named
take no part.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .common import discard, materialize, read_table

ARITY, SPAN = 2, 5
#: Groups up to which their table is broadcast; more are joined.
MOST_GROUPS = 50_000
#: Rows that a range of ordered leaves is meant to hold.
RANGE_ROWS = 500_000

PROOF = "array<struct<left string, right string>>"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """Digest of a row's fields, each `-` or its length in UTF-8 bytes, a colon, and itself."""
    shown = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*shown), 256)


def fold(leaf: str, proof: list[dict]) -> str:
    """The root that a leaf and its proof lead to."""
    for level in proof:
        leaf = digest(level["left"], leaf, level["right"])
    return leaf


def depth(n: int, arity: int = ARITY) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


# -------------------------------------------------------------------- the order


def places(leaves: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds idx, the place in its group, and n, the group's size.

    Rows are sorted by ranges, so a group spreads over many; a range's rows of a
    group begin where the ranges before it end, which a table of one row a range
    and group tells.  Rows that agree on `order` are alike for the caller.
    """
    kept = leaves.columns
    ranges = max(1, -(-leaves.count() // RANGE_ROWS), int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    alike = F.monotonically_increasing_id()  # so that a long run of alike rows spreads, too
    ordered = leaves.withColumn("_tie", alike).repartitionByRange(ranges, *group, *order, "_tie").sortWithinPartitions(*group, *order, "_tie").drop("_tie")
    ordered = materialize(ordered.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "merkle-order")
    spans = ordered.groupBy("_part", *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(*group)  # one row a range
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("n"))
    same = functools.reduce(operator.and_, [F.col("_part") == F.col("_p"), *[F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]])
    return ordered.join(spans, same).select(*kept, (F.col("_at") - F.col("_first") + F.col("_before")).alias("idx"), "n")


# --------------------------------------------------------------------- the tree


@dataclass
class Tree:
    """The written levels, lowest first, and one row a group: group, digest.

    A level's rows: group, run (its place), rest (tree levels from these nodes to
    the root), hashes (of the run's nodes) and, lowest level only, payload.
    """

    levels: list[DataFrame]
    roots: DataFrame
    arity: int
    span: int

    def discard(self) -> None:
        discard(*self.levels)


def _up(hashes: list[str], levels: int, arity: int) -> list[list[str]]:
    """Digests of a run's subtree, level by level from the given ones."""
    rows = [hashes]
    for _ in range(levels):
        rows.append([digest(*rows[-1][i : i + arity]) for i in range(0, len(rows[-1]), arity)])
    return rows


def build(nodes: DataFrame, payload: list[str], arity: int = ARITY, span: int = SPAN) -> Tree:
    """The trees of nodes (grp, idx, n, hash, payload...): idx from 0 without gaps in a group of n."""
    width = arity**span
    carried = [F.col(c) for c in ("idx", "hash", *payload)]
    most = nodes.agg(F.max("n")).first()[0] or 0
    above = F.lit(0)  # tree levels above n leaves
    for level in range(depth(most, arity)):
        above = F.when(F.col("n") > arity**level, level + 1).otherwise(above)
    nodes = nodes.withColumn("rest", above)
    levels, finished = [], []
    for step in range(max(1, -(-depth(most, arity) // span))):
        run = F.floor(F.col("idx") / width).alias("run")
        runs = nodes.groupBy("grp", run, "rest").agg(F.array_sort(F.collect_list(F.struct(*(carried if not step else carried[:2])))).alias("nodes"))
        runs = runs.withColumn("hashes", F.col("nodes.hash"))
        runs = runs.withColumn("payload", F.transform("nodes", lambda x: F.struct(*[x[c] for c in payload]))) if not step and payload else runs
        runs = runs.drop("nodes")

        def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [_up(h, min(span, rest), arity)[-1][0] for h, rest in zip(b.column("hashes").to_pylist(), b.column("rest").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], [*b.schema.names, "top"])

        written = materialize(runs.mapInArrow(tops, StructType([*runs.schema.fields, *StructType.fromDDL("top string").fields])), f"merkle-{step}")
        levels.append(written)
        finished.append(written.where(F.col("rest") <= span).select("grp", F.col("top").alias("digest")))
        nodes = written.where(F.col("rest") > span).select("grp", F.col("run").alias("idx"), F.col("top").alias("hash"), (F.col("rest") - span).alias("rest"))
    return Tree(levels, functools.reduce(DataFrame.union, finished), arity, span)


def push(tree: Tree, above: DataFrame) -> DataFrame:
    """Rows (grp, idx, hash, payload..., kept..., proof) of all leaves.

    above: one row a group: grp, proof (what follows the subroot's own siblings)
    and columns to keep.  Each level's rows meet what their parents inherited.
    """
    arity, span = tree.arity, tree.span
    kept = [c for c in above.columns if c not in ("grp", "proof")]
    inherited = None  # grp, idx, kept..., proof: of a level's runs

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            proofs = []
            for hashes, rest, suffix in zip(*(b.column(c).to_pylist() for c in ("hashes", "rest", "proof")), strict=True):
                rows = _up(hashes, min(span, rest), arity)[:-1]
                own = []
                for i in range(len(hashes)):
                    mine, at = [], i
                    for row in rows:
                        first = at - at % arity
                        mine.append({"left": "".join(row[first:at]), "right": "".join(row[at + 1 : first + arity])})
                        at //= arity
                    own.append(mine + suffix)
                proofs.append(own)
            names = [n for n in b.schema.names if n != "proof"]
            kind = pa.list_(pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(proofs, kind)], [*names, "proofs"])

    for step in reversed(range(len(tree.levels))):
        level = tree.levels[step].drop("top")
        ends = above.join(level.where(F.col("rest") <= span).select(F.col("grp").alias("_grp")), F.col("grp").eqNullSafe(F.col("_grp"))).select("grp", F.lit(0).cast("long").alias("idx"), *kept, "proof")
        inherited = ends if inherited is None else ends.unionByName(inherited)
        parents = inherited.withColumnRenamed("grp", "_grp")
        met = level.join(parents, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("run") == F.col("idx"))).drop("_grp", "idx")
        shown = met.drop("proof")
        pushed = met.mapInArrow(children, StructType([*shown.schema.fields, *StructType.fromDDL(f"proofs array<{PROOF}>").fields]))
        lists = ["hashes", "proofs"] + (["payload"] if "payload" in level.columns else [])
        pushed = pushed.select("grp", "run", *kept, F.posexplode(F.arrays_zip(*lists)).alias("_i", "_x"))
        place = (F.col("run") * arity**span + F.col("_i")).alias("idx")
        if step:
            inherited = materialize(pushed.select("grp", place, *kept, F.col("_x.proofs").alias("proof")), "merkle-proofs")
        else:
            extra = [F.col(f"_x.payload.{f.name}").alias(f.name) for f in level.schema["payload"].dataType.elementType] if "payload" in lists else []
            return pushed.select("grp", place, F.col("_x.hashes").alias("hash"), *extra, *kept, F.col("_x.proofs").alias("proof"))
    raise AssertionError("a tree has at least one level")


# ----------------------------------------------------------------- the manifest


def manifest(rows: DataFrame, group: str, key: str, fields: list[str], carry: dict[str, Column] | None = None, arity: int = ARITY, span: int = SPAN) -> DataFrame:
    """Each row's leaf with subroot, root and proof (PROOF); carry: further columns of a row to keep.

    Returns key, grp, idx (its place in the group), leaf, subroot, root, proof and the carried ones.
    """
    carry = carry or {}
    leaves = materialize(rows.select(F.col(group).alias("grp"), F.col(key).alias("key"), leaf(*[F.col(f) for f in fields]).alias("hash"), *[c.alias(f"c_{n}") for n, c in carry.items()]), "merkle-leaves")
    payload = ["key", *[f"c_{n}" for n in carry]]
    tree = build(places(leaves, ["grp"], ["key", "hash"]), payload, arity, span)
    subroots = materialize(tree.roots.select(F.lit(0).alias("one"), F.col("grp").alias("name"), F.col("digest").alias("hash")), "merkle-subroots")
    upper = build(places(subroots, ["one"], ["name"]).withColumnRenamed("one", "grp"), ["name"], arity, span)
    top = upper.roots.select("grp", F.col("digest").alias("root"), F.expr(f"CAST(array() AS {PROOF})").alias("proof"))
    above = materialize(push(upper, top).select(F.col("name").alias("grp"), F.col("hash").alias("subroot"), "root", "proof"), "merkle-above")
    if above.count() <= MOST_GROUPS:  # checked
        above = F.broadcast(above)
    found = push(tree, above)
    return found.select("key", "grp", "idx", F.col("hash").alias("leaf"), "subroot", "root", "proof", *[F.col(f"c_{n}").alias(n) for n in carry])


def verified(found: DataFrame, leaf: str = "leaf", root: str = "root", proof: str = "proof") -> DataFrame:
    """Adds proof_sha256 (digest of all siblings, left to right, level by level), folded_root and verified; proof goes."""
    kept = [f for f in found.schema.fields if f.name != proof]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            proofs = b.column(proof).to_pylist()
            said = [digest(*itertools.chain.from_iterable((x["left"], x["right"]) for x in p)) for p in proofs]
            folded = [fold(h, p) for h, p in zip(b.column(leaf).to_pylist(), proofs, strict=True)]
            same = [f == r for f, r in zip(folded, b.column(root).to_pylist(), strict=True)]
            columns = [*(b.column(f.name) for f in kept), pa.array(said, pa.string()), pa.array(folded, pa.string()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), "proof_sha256", "folded_root", "verified"])

    return found.mapInArrow(run, StructType([*kept, *StructType.fromDDL("proof_sha256 string, folded_root string, verified boolean").fields]))


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    changed = leaf(*[F.col(f) + 1 if f == "n_chars" else F.col(f) for f in FIELDS])
    found = manifest(docs, "lang", "doc_id", FIELDS, {"changed": F.when(touched & F.col("n_chars").isNotNull(), changed)})
    shown = verified(found.withColumn("given", F.coalesce("changed", "leaf")).drop("changed"), "given")
    return shown.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


#: CRC-32 of a short text of ASCII characters, bit by bit: each byte enters at the first of its eight steps.
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({0}, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, v: xor(xor(c, v) >> 1, (xor(c, v) & 1) * 3988292384)), 4294967295)"


def _shown(field: str) -> str:
    return f"coalesce(strlen({field}::VARCHAR) || ':' || {field}::VARCHAR, '-')"


def _leaf_sql(fields: list[str]) -> str:
    return f"sha256({' || '.join(map(_shown, fields))})"


SQL = f"""WITH RECURSIVE leaves AS (
  SELECT row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, {_leaf_sql(FIELDS)}) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, doc_id,
    {_leaf_sql(FIELDS)} AS h, CASE WHEN {CRC.format('doc_id::VARCHAR')} % 7 = 0 AND n_chars IS NOT NULL THEN {_leaf_sql([f.replace('n_chars', '(n_chars + 1)') for f in FIELDS])} END AS changed FROM documents),
low AS (SELECT g, 0 AS lvl, idx, n, h FROM leaves UNION ALL SELECT g, lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM low WHERE n > 1 GROUP BY g, lvl, idx // 2, n),
subs AS (SELECT g AS idx, h, (SELECT count(DISTINCT g) FROM leaves) AS n FROM low WHERE n = 1),
high AS (SELECT 0 AS lvl, idx, n, h FROM subs UNION ALL SELECT lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY lvl, idx // 2, n),
tops AS (SELECT h AS root FROM high WHERE n = 1),
steps AS (SELECT l.g, l.idx, t.lvl, t.idx AS at, s.h FROM leaves l JOIN low t ON t.g = l.g AND t.idx = l.idx // (2 ** t.lvl)::BIGINT AND t.n > 1 LEFT JOIN low s ON s.g = l.g AND s.lvl = t.lvl AND s.idx = xor(t.idx, 1)
  UNION ALL SELECT l.g, l.idx, 1000 + t.lvl, t.idx, s.h FROM leaves l JOIN high t ON t.idx = l.g // (2 ** t.lvl)::BIGINT AND t.n > 1 LEFT JOIN high s ON s.lvl = t.lvl AND s.idx = xor(t.idx, 1)),
proofs AS (SELECT l.g, l.idx, sha256(coalesce(string_agg(s.h, '' ORDER BY s.lvl), '')) AS proof_sha256, list({{'at': s.at, 'h': coalesce(s.h, '')}} ORDER BY s.lvl) FILTER (s.lvl IS NOT NULL) AS path FROM leaves l LEFT JOIN steps s USING (g, idx) GROUP BY l.g, l.idx),
folds AS (SELECT g, idx, 1 AS i, coalesce(l.changed, l.h) AS h, coalesce(path, []) AS path FROM leaves l JOIN proofs USING (g, idx)
  UNION ALL SELECT g, idx, i + 1, CASE WHEN path[i].at % 2 = 1 THEN sha256(path[i].h || h) ELSE sha256(h || path[i].h) END, path FROM folds WHERE i <= len(path))
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, root, proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM leaves l JOIN subs s ON s.idx = l.g JOIN proofs p ON p.g = l.g AND p.idx = l.idx JOIN folds f ON f.g = l.g AND f.idx = l.idx AND f.i = len(f.path) + 1 CROSS JOIN tops"""
