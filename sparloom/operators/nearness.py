"""Exact cosine self-join of hashing embeddings without comparing all pairs.

Let D be the components whose signs differ between two unit vectors x and y (a zero
has no sign).  What x and y hold outside D bounds their product, so x.y >= t asks for
sum of x_i^2 + y_i^2 over D <= 2 (1 - t).  Every component of D costs at least the
lesser of both vectors' least non-zero squares, so D has at most max(m(x), m(y))
components, m = floor(2 (1 - t) / least square).  Split all components into more
groups than that, and in one group the signs of x and y agree: that group's pattern of
signs is a key that both have.  A vector owns the level (a power of two of groups)
that its own m asks for, and is a guest of the levels above it; pairs are sought
between a level's owners and all its vectors.  As many non-zero components differ at
most, keys hold the vector's number of them in overlapping ranges as well.

Above MOST_GROUPS groups (long texts) a group is too small for its pattern to tell
texts apart.  Such vectors meet all others by blocks: the product of HEAD components
plus that of the norms of all others bounds a pair, which leaves few to be multiplied
out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import cut
from .retrieval import ROWS, Tokens

#: Groups of the highest level, and rows of a block of vectors that have no level.
MOST_GROUPS, BLOCK = 16, 4_096
#: Components whose products, with the norms of the others, bound a pair of such a block.
HEAD = 32
#: Scores are compared when rounded to six digits.
SLACK = 1e-6

_random = np.random.default_rng(20240229)  # weights of (component, sign); a clash only adds a candidate
_WEIGHTS = _random.integers(1, 1 << 63, (2, 1 << 12), np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)

VECTORS = "id long, own int, slots binary, counts binary"


def counted(held: Tokens, dim: int) -> np.ndarray:
    """Signed token counts by slot, whole numbers."""
    from .retrieval import _slot

    slots = np.array([_slot(t, dim) for t in held.names], np.int64).reshape(-1, 2)
    return np.bincount(held.row * dim + slots[held.token, 0], weights=slots[held.token, 1], minlength=len(held.n) * dim).reshape(-1, dim).astype(np.int64)


def level(counts: np.ndarray, least: float) -> np.ndarray:
    """Groups that each row's own components ask for; 0: none at all (a zero row), above MOST_GROUPS: no level."""
    size = np.abs(counts)
    total = (size * size).sum(axis=1)
    smallest = np.where(size > 0, size, np.iinfo(np.int64).max).min(axis=1).astype(float)
    m = np.floor(2 * (1 - least + SLACK) * total / np.minimum(smallest, 1e9) ** 2 + 1e-9)
    return np.where(total == 0, 0, 2 ** np.ceil(np.log2(m + 1)).astype(np.int64))


def keys(counts: np.ndarray, groups: int) -> np.ndarray:
    """(rows, 2 * groups): each row's keys at a level."""
    signs = np.zeros((len(counts), -(-counts.shape[1] // MOST_GROUPS) * MOST_GROUPS), np.uint64)
    few = counts.shape[1]
    signs[:, :few] = np.where(counts > 0, _WEIGHTS[0, :few], np.where(counts < 0, _WEIGHTS[1, :few], np.uint64(0)))
    pattern = signs.reshape(len(counts), groups, -1).sum(axis=2) + np.arange(groups, dtype=np.uint64) * _ODD
    span = np.count_nonzero(counts, axis=1)[:, None].astype(np.uint64) // np.uint64(groups)
    out = [(pattern ^ (span + np.uint64(i) + np.uint64(groups * 1_000_003))) * _ODD for i in (0, 1)]  # numbers less than `groups` apart share a span
    return np.concatenate([x ^ (x >> np.uint64(29)) for x in out], axis=1).astype(np.int64)


def vectors(texts: DataFrame, least: float, dim: int) -> DataFrame:
    """VECTORS of texts (id, t: tokens) without zero ones: their non-zero counts by slot, and the level they own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                some = batch.slice(i, ROWS)
                counts = counted(Tokens(some.column(1)), dim)
                own = level(counts, least)
                kept = np.flatnonzero(own)
                at = [np.flatnonzero(counts[r]) for r in kept]
                yield pa.RecordBatch.from_arrays([
                    some.column(0).take(pa.array(kept)), pa.array(own[kept].clip(max=1 << 30), pa.int32()),
                    pa.array([a.astype(np.int16).tobytes() for a in at], pa.binary()), pa.array([counts[r][a].astype(np.int32).tobytes() for r, a in zip(kept, at, strict=True)], pa.binary()),
                ], ["id", "own", "slots", "counts"])

    return texts.select(F.col("id").cast("long"), "t").mapInArrow(run, VECTORS)


def keyed(rows: DataFrame, dim: int) -> DataFrame:
    """(id, key, owner) of VECTORS rows that have a level: their keys at each level that some row owns and that is not below their own."""
    levels = sorted(r[0] for r in rows.where(F.col("own") <= MOST_GROUPS).select("own").distinct().collect())  # powers of two

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = _counts(batch.column(2).to_pylist(), batch.column(3).to_pylist(), dim)
            ids, own = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for groups in levels:
                mine = np.flatnonzero(own <= groups)
                found = keys(counts[mine], groups)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[mine], 2 * groups)), pa.array(found.ravel()), pa.array(np.repeat(own[mine] == groups, 2 * groups))], ["id", "key", "owner"])

    return rows.where(F.col("own") <= MOST_GROUPS).mapInArrow(run, "id long, key long, owner boolean")


def _counts(slots: list[bytes], counts: list[bytes], dim: int) -> np.ndarray:
    out = np.zeros((len(slots), dim))
    for row, (s, c) in enumerate(zip(slots, counts, strict=True)):
        out[row, np.frombuffer(s, np.int16)] = np.frombuffer(c, np.int32)
    return out


def _dense(slots: list[bytes], counts: list[bytes], dim: int) -> np.ndarray:
    out = _counts(slots, counts, dim)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def confirmed(pairs: DataFrame, rows: DataFrame, least: float, dim: int) -> DataFrame:
    """(a, b) of pairs whose rounded product is least or more."""
    first, second = (rows.select(F.col("id").alias(n), F.struct("slots", "counts").alias(f"v{n}")) for n in ("a", "b"))
    met = pairs.join(first, "a").join(second, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_dense(batch.column(n).field("slots").to_pylist(), batch.column(n).field("counts").to_pylist(), dim) for n in ("va", "vb"))
            near = pa.array(np.round((x * y).sum(axis=1), 6) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(n).filter(near) for n in ("a", "b")], ["a", "b"])

    return met.select("a", "b", "va", "vb").mapInArrow(run, "a long, b long")


def shared_keys(rows: DataFrame, dim: int) -> DataFrame:
    """(key, id, owner, first): rows of keys that an owner shares with another, beside the key's least id."""
    each = keyed(rows, dim)
    told = each.groupBy("key").agg(F.min("id").alias("first"), F.count_if("owner").alias("owners"), F.count("*").alias("n")).where("owners > 0 AND n > 1").select("key", "first")
    return each.join(told, "key")


def later(texts: DataFrame, least: float, dim: int = 384) -> DataFrame:
    """(id) of texts (id, t: tokens) that some text with a smaller id is as near to as least.

    Each text is first held against the least id of each of its keys, so that one
    that belongs to a large family is told by its first member; only the others then
    meet all smaller ids of their keys.  Either way a pair is decided by its vectors.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    rows = cut(vectors(texts, least, dim))
    shared = cut(shared_keys(rows, dim))
    firsts = shared.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    told = cut(confirmed(firsts, rows, least, dim).select(F.col("b").alias("id")).distinct())
    open_ = shared.join(told, "id", "left_anti")
    low = shared.select("key", F.col("id").alias("a"), F.col("owner").alias("own_a"))
    met = open_.join(low, "key").where("a < id AND a > first AND (owner OR own_a)")
    rest = confirmed(met.select("a", F.col("id").alias("b")).distinct(), rows, least, dim).select(F.col("b").alias("id"))
    found = told.union(rest)
    if not rows.where(F.col("own") > MOST_GROUPS).isEmpty():
        found = found.union(_by_blocks(rows, least, dim))
    return found.distinct()


def _by_blocks(rows: DataFrame, least: float, dim: int) -> DataFrame:
    """The later id of near pairs of which one has no level: blocks of these against blocks of all."""
    wide = rows.where(F.col("own") > MOST_GROUPS)
    n_wide, n = wide.count(), rows.count()
    ones, twos = -(-n_wide // BLOCK), -(-n // BLOCK)
    block = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = wide.select(block(ones).alias("one"), every(twos).alias("two"), F.lit(True).alias("left"), "id", "slots", "counts")
    right = rows.select(every(ones).alias("one"), block(twos).alias("two"), F.lit(False).alias("left"), "id", "slots", "counts")

    def find(table: pa.Table) -> pa.Table:
        side, ids = np.asarray(table.column("left")), np.asarray(table.column("id"))
        vectors = _dense(table.column("slots").to_pylist(), table.column("counts").to_pylist(), dim)
        one, two, late = np.flatnonzero(side), np.flatnonzero(~side), set()
        head = vectors[:, :HEAD].astype(np.float32)
        rest = np.sqrt(np.maximum(1 - (head * head).sum(axis=1), 0))
        for i in range(0, len(one), ROWS):
            some = one[i : i + ROWS]
            x, y = np.nonzero(head[some] @ head[two].T + np.outer(rest[some], rest[two]) >= least - 1e-4)
            x, y = some[x], two[y]
            open_ = ids[x] != ids[y]
            x, y = x[open_], y[open_]
            for j in range(0, len(x), 8 * ROWS):
                u, v = x[j : j + 8 * ROWS], y[j : j + 8 * ROWS]
                near = np.round((vectors[u] * vectors[v]).sum(axis=1), 6) >= least
                late.update(np.maximum(ids[u], ids[v])[near].tolist())
        return pa.table({"id": pa.array(sorted(late), pa.int64())})

    return left.union(right).groupBy("one", "two").applyInArrow(find, "id long")


def near_earlier(rows: DataFrame, least: float, dim: int = 384) -> DataFrame:
    """(id) of rows (id, text) that some row with a smaller id is as near to as least, by hashing cosine.

    Equal texts are one text; those beyond the first are near it.
    """
    first = cut(rows.groupBy("text").agg(F.min("id").alias("first")))
    near = later(first.select(F.col("first").alias("id"), tokens(F.col("text")).alias("t")), least, dim)
    marked = rows.join(first, "text").join(near.select(F.col("id").alias("first"), F.lit(True).alias("near")), "first", "left")
    return marked.where("near or id > first").select("id")
