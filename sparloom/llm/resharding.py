"""Minimum-cost-flow resharding.

Given the sizes of old shards and the capacities of new ones, a transportation
problem decides how many bytes go from each old to each new shard at the least
cost (by default: the fewest bytes that change shard).  Each flow becomes one
block transfer: a run of the old shard's rows in their order from large to
small, so that what stays is the large rows and the cuts fall between small
ones.  Rows are placed by running sums that are exact and never sort a shard in
one task: per (shard, size) cell sums, then ranks inside a cell by hash bucket.

The solver works on shards, not rows: its input is one number a shard (MAX_SHARDS at
most, checked).  Where a move costs the same wherever it goes, the flow is found in
linear time; other costs take successive shortest paths, a second at 400 shards, and
grow by the cube.  Rewriting touches only the shards that gain or lose
rows; the others keep their files.

Defined cases: a null text has 0 bytes (16 with the overhead); a null old shard
is shard 0; rows with equal ids are separate rows; an empty table stays empty.
"""

from __future__ import annotations

import itertools
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize, ranked, read_table, shared_dir

MAX_SHARDS = 10_000


def min_cost_flow(supply: list[int], capacity: list[int], cost: np.ndarray) -> np.ndarray:
    """Bytes from each old (row) to each new shard (column) of least total cost.

    Successive shortest paths with potentials on the dense bipartite graph.
    """
    left, room = np.array(supply, np.int64), np.array(capacity, np.int64)
    m, n = len(left), len(room)
    if left.sum() > room.sum():
        raise ValueError("new shards can't hold all bytes")
    flow, cost = np.zeros((m, n), np.int64), np.asarray(cost, float)
    cost = cost - min(0.0, cost.min(initial=0.0))
    u, v = np.zeros(m), np.zeros(n)  # potentials: cost + u - v stays >= 0, and v is equal where there is room
    while left.any():
        start = int(np.argmax(left))
        from_new, from_old = np.full(m, -1), np.full(n, -1)
        dist_old, dist_new = np.full(m, np.inf), np.full(n, np.inf)
        done_old, done_new = np.zeros(m, bool), np.zeros(n, bool)
        dist_old[start] = 0.0
        while True:
            i = int(np.argmin(np.where(done_old, np.inf, dist_old)))
            j = int(np.argmin(np.where(done_new, np.inf, dist_new)))
            d_i = np.inf if done_old[i] else dist_old[i]
            d_j = np.inf if done_new[j] else dist_new[j]
            if d_j <= d_i:
                done_new[j] = True
                if room[j] > 0:
                    break
                back = np.where(flow[:, j] > 0, d_j - (cost[:, j] + u - v[j]), np.inf)
                nearer = ~done_old & (back < dist_old)
                dist_old[nearer], from_new[nearer] = back[nearer], j
            else:
                done_old[i] = True
                out = d_i + np.maximum(cost[i] + u[i] - v, 0.0)
                nearer = ~done_new & (out < dist_new)
                dist_new[nearer], from_old[nearer] = out[nearer], i
        end, reach = j, dist_new[j]
        path, amount, at = [], int(min(left[start], room[end])), end
        while True:
            i = int(from_old[at])
            path.append((i, at, 1))
            if i == start:
                break
            at = int(from_new[i])
            path.append((i, at, -1))
            amount = min(amount, int(flow[i, at]))
        for i, j, way in path:
            flow[i, j] += way * amount
        left[start] -= amount
        room[end] -= amount
        u += np.minimum(dist_old, reach)
        v += np.minimum(dist_new, reach)
    return flow


def stay_flow(supply: dict[int, int], capacity: list[int]) -> list[tuple[int, int, int]]:
    """(old, new, bytes) of least cost where staying is free and every move costs the same.

    The free arcs are filled as far as they can be; what is left then costs the
    same whichever way it goes, so it fills the room in order.  No more than
    old + new arcs beside the free ones, in linear time.
    """
    if sum(supply.values()) > sum(capacity):
        raise ValueError("new shards can't hold all bytes")
    room, arcs = list(capacity), []
    left = dict(sorted(supply.items()))
    for o in left:
        stays = min(left[o], room[o]) if 0 <= o < len(room) else 0
        if stays:
            arcs.append((o, o, stays))
            left[o] -= stays
            room[o] -= stays
    j = 0
    for o, more in left.items():
        while more:
            while not room[j]:
                j += 1
            goes = min(more, room[j])
            arcs.append((o, j, goes))
            more -= goes
            room[j] -= goes
    return arcs


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def transfers(old_sizes: dict[int, int], capacities: list[int], cost: np.ndarray | None = None) -> list[tuple[int, int, int, int]]:
    """Blocks (old, new, first byte, end byte) of each old shard's row order; what stays comes first."""
    olds, n = sorted(old_sizes), len(capacities)
    if max(len(olds), n) > MAX_SHARDS:
        raise ValueError(f"{MAX_SHARDS} shards at most")
    if cost is None:
        arcs = stay_flow(old_sizes, capacities)
    else:
        flow = min_cost_flow([old_sizes[o] for o in olds], capacities, cost)
        arcs = [(olds[i], int(j), int(flow[i, j])) for i, j in zip(*np.nonzero(flow), strict=True)]
    out, at = [], dict.fromkeys(olds, 0)
    for o, j, n_bytes in sorted(arcs, key=lambda a: (a[0], a[1] != a[0], a[1])):
        out.append((o, j, at[o], at[o] + n_bytes))
        at[o] += n_bytes
    return out


def reshard(rows: DataFrame, shards: int, cost: np.ndarray | None = None, order: tuple[str, ...] = ("key",)) -> DataFrame:
    """Adds shard to rows (old_shard int, size long > 0, and the columns of order).

    Shards get near equal bytes with the fewest bytes moved.
    """
    spark = rows.sparkSession
    cells = rows.groupBy("old_shard", "size").agg(F.count("*").alias("_n"))
    larger = Window.partitionBy("old_shard").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    cells = materialize(cells.withColumn("_before", F.coalesce(F.sum(F.col("_n") * F.col("size")).over(larger), F.lit(0))), "reshard-cells")
    old = {r[0]: int(r[1]) for r in cells.groupBy("old_shard").agg(F.sum(F.col("_n") * F.col("size"))).collect()}
    blocks = transfers(old, even_capacities(sum(old.values()), shards), cost)
    told = F.broadcast(spark.createDataFrame(blocks, "old_shard int, shard int, _from long, _to long"))  # old + new - 1 blocks at most
    placed = ranked(rows, ["old_shard", "size"], list(order), "_place").join(cells, ["old_shard", "size"])
    middle = F.col("_before") + F.col("_place") * F.col("size") + F.col("size") / 2
    placed = placed.withColumn("_middle", middle)
    inside = (F.col("_middle") >= F.col("_from")) & (F.col("_middle") < F.col("_to"))
    return placed.join(told, (placed["old_shard"] == told["old_shard"]) & inside).select(*[placed[c] for c in rows.columns], "shard")


def slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds slot: gapless from 0 in each shard."""
    return ranked(rows, ["shard"], order, "slot")


def sized(docs: DataFrame, old_shard, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32 and old_shard of each row: all that placing needs."""
    value = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("key"), (F.octet_length(value) + 16).cast("long").alias("size"), F.crc32(value).alias("text_crc32"), F.coalesce(old_shard, F.lit(0)).cast("int").alias("old_shard"))


#: Bytes (about) of a file that a rewritten shard is cut into.
FILE_BYTES = 256 << 20


def rewrite(spark: SparkSession, old: str | DataFrame, new_path: str, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Reshards a dataset kept as old/shard=K, or rows with a column shard; returns shard, path: where each shard's rows now are.

    Shards that neither gain nor lose rows keep their old folder (rows without one
    are written all the same); the others are written whole to new_path/shard=K, a
    large shard by several tasks.  Old files stay, so a failed run can be repeated;
    new_path must be another folder.

    Texts are shuffled once, to their new files.  A row's place follows from its
    old shard and size, but for the sizes that a cut between two blocks divides:
    rows of these are told by (key, crc of the text); of those that agree on both
    and lie on both sides of a cut, as many go as each shard gets.
    """
    if isinstance(old, str) and new_path.rstrip("/") == old.rstrip("/"):
        raise ValueError("new_path must not be the old one: old files stay until the new ones are there")
    docs = spark.read.parquet(old) if isinstance(old, str) else old
    rows = materialize(sized(docs, F.col("shard"), key, text), "rewrite")
    moved = materialize(reshard(rows, shards, order=("key", "text_crc32")), "rewrite-plan")
    new = moved.select("shard").distinct()
    if isinstance(old, str):
        changes = moved.where("old_shard <> shard")
        new = changes.select("shard").union(changes.select(F.col("old_shard").alias("shard"))).distinct()
    changed = [r[0] for r in new.collect()]  # shards, MAX_SHARDS at most
    goes = F.col("shard").isin(changed)
    sizes = {r[0]: int(r[1]) for r in moved.where(goes).groupBy("shard").agg(F.sum("size")).collect()}
    cells = materialize(moved.where(goes).groupBy("old_shard", "size").agg(F.min("shard").alias("_lo"), F.max("shard").alias("_hi")), "rewrite-cells")
    ranges = cells.where("_lo = _hi").groupBy(F.col("old_shard").alias("_old"), "_lo").agg(F.min("size").alias("_from"), F.max("size").alias("_to"))  # fewer than blocks
    divided = cells.where("_lo < _hi").select(F.col("old_shard").alias("_old"), F.col("size").alias("_cell"))  # fewer than cuts
    value = F.coalesce(F.col(text), F.lit(""))
    mine = docs.where(goes) if isinstance(old, str) else docs
    mine = mine.withColumns({"_o": F.coalesce(F.col("shard"), F.lit(0)).cast("int"), "_size": (F.octet_length(value) + 16).cast("long"), "_crc": F.crc32(value)})
    names = [c for c in docs.columns if c != "shard"]
    out = mine.join(F.broadcast(ranges), (F.col("_o") == F.col("_old")) & F.col("_size").between(F.col("_from"), F.col("_to"))).select(*[mine[c] for c in names], F.col("_lo").alias("shard"))
    if not divided.isEmpty():
        some = mine.join(F.broadcast(divided), (F.col("_o") == F.col("_old")) & (F.col("_size") == F.col("_cell")), "left_semi")
        plan = moved.join(F.broadcast(divided), (F.col("old_shard") == F.col("_old")) & (F.col("size") == F.col("_cell")), "left_semi")
        same = ["key", "text_crc32", "old_shard"]
        each = plan.groupBy(*same, "shard").agg(F.count("*").alias("_n"))
        lists = each.groupBy(*same).agg(F.array_sort(F.collect_list(F.struct("shard", "_n"))).alias("_to"))  # a place a shard
        on = some[key].eqNullSafe(lists["key"]) & (some["_crc"] == lists["text_crc32"]) & (some["_o"] == lists["old_shard"])
        told = some.join(lists, on).select(*[some[c] for c in names], "_crc", "_o", "_to")
        single = told.where(F.size("_to") == 1).select(*names, F.col("_to")[0]["shard"].alias("shard"))
        nth = F.row_number().over(Window.partitionBy(F.col(key), "_crc", "_o").orderBy(F.lit(0)))
        pick = F.aggregate("_to", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("to")), lambda s, t: F.struct((s["seen"] + t["_n"]).alias("seen"), F.coalesce(s["to"], F.when(F.col("_nth") <= s["seen"] + t["_n"], t["shard"])).alias("to")))
        out = out.union(single).union(told.where(F.size("_to") > 1).withColumn("_nth", nth).select(*names, pick["to"].alias("shard")))
    pieces = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for s, n in (sizes or {0: 0}).items() for x in (s, max(1, -(-n // FILE_BYTES)))]), F.col("shard")), F.lit(1))
    salted = out.withColumn("_piece", F.pmod(F.xxhash64(key, F.crc32(value)), pieces))
    salted.repartition("shard", "_piece").drop("_piece").write.partitionBy("shard").mode("overwrite").parquet(new_path)
    where = F.when(goes, F.lit(new_path)).otherwise(F.lit(old if isinstance(old, str) else new_path))
    told = materialize(moved.select("shard").distinct().select("shard", F.concat(where, F.lit("/shard="), F.col("shard")).alias("path")), "rewrite-paths")
    discard(rows, moved, cells)
    return told


def shard_rows(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """The rows of the shards that rewrite() names, with their shard."""
    out = None
    known = sorted(p for _, p in paths.collect())  # a path a shard
    for root, mine in itertools.groupby(known, lambda p: p.rsplit("/", 1)[0]):
        part = spark.read.option("basePath", root).parquet(*mine)
        out = part if out is None else out.unionByName(part)
    return out


OLD_SHARDS, NEW_SHARDS = 32, 40


def op3_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as 32 shards by source (very uneven), rewritten into files of 40 shards of near equal bytes.

    The digest is taken from the rewritten files.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.pmod(F.xxhash64("source"), F.lit(OLD_SHARDS)).cast("int").alias("shard"))
    if docs.isEmpty():
        return docs.select("doc_id", F.lit(16).cast("long").alias("size"), F.lit(0).cast("long").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    new = shard_rows(spark, rewrite(spark, docs, f"{shared_dir(spark)}/op3-{uuid.uuid4().hex}", NEW_SHARDS))
    rows = materialize(sized(new, F.col("shard")).withColumnRenamed("old_shard", "shard"), "op3")
    placed = slots(rows, ["key", "text_crc32"])
    return placed.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
