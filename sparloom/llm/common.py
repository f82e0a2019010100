"""What the operators share: shared storage, words of Arrow batches, exact
distributed ranks, and connected components.
"""

from __future__ import annotations

import functools
import operator
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import session

#: A word is a run of characters that are not blank, tab, newline, VT, FF or CR.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Text bytes that one step of an Arrow batch holds at once (one longer text: alone).
STEP_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (session.shared_folder)."""
    return session.shared_folder(spark)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet into the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path  # for discard()
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the folders of materialized frames that nothing reads any more.

    The driver's collector is asked to run, so that executors drop the shuffle
    files of finished steps as well.
    """
    for df in frames:
        if path := getattr(df, "_folder", None):
            jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)
            df._folder = None
    if frames:
        frames[0].sparkSession._jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def n_words(text) -> F.Column:
    """Words of a text, null: 0, without a Python worker."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


# ---------------------------------------------------------------- Arrow batches


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have `limit` bytes at most, or one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += int(n)
    if len(sizes) > first:
        yield batch.slice(first)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (rows + 1) and bytes of a text column; null reads as empty."""
    filled = pc.fill_null(column.cast(pa.large_binary()), b"")
    at = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    raw = filled.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8)
    return at - at[0], data[at[0] : at[-1]]


def words(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word of all rows, and each row's first word (rows + 1)."""
    solid = ~SPACES[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.concatenate(([False], solid[:-1]))
    after = np.concatenate((solid[1:], [False]))
    begin = np.flatnonzero(solid & (~before | edge[:-1]))
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return begin, end, np.searchsorted(begin, at)


#: Bytes over which prefix sums are held at once, whatever the text's length.
_SPAN = 1 << 18


def _powers(base: np.uint64) -> np.ndarray:
    full = np.full(_SPAN + 1, base, np.uint64)
    full[0] = 1
    return np.cumprod(full, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE), _powers(_BASE_INV)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_letter = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _sums(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial of each word's bytes; data has _SPAN bytes at most."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_letter[data] * _UP[: len(data)], out=sums[1:])
    return (sums[end] - sums[begin]) * _DOWN[begin]


def _long_sum(data: np.ndarray) -> np.uint64:
    """The same of one word of any length, piece by piece."""
    total, scale = np.zeros(1, np.uint64), np.ones(1, np.uint64)
    for i in range(0, len(data), _SPAN):
        piece = data[i : i + _SPAN]
        total = total + scale * _sums(piece, np.array([0]), np.array([len(piece)]))
        scale = scale * _UP[_SPAN : _SPAN + 1]
    return total[0]


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes, from prefix sums over spans of bounded size."""
    out = np.empty(len(begin), np.uint64)
    i = 0
    while i < len(begin):
        at = begin[i]
        j = int(np.searchsorted(end, at + _SPAN, "right"))
        if j > i:
            out[i:j] = _sums(data[at : end[j - 1]], begin[i:j] - at, end[i:j] - at)
        else:
            j = i + 1
            out[i] = _long_sum(data[at : end[i]])
        i = j
    return mix(out + (end - begin).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z as a-z."""
    return data + ((data >= 0x41) & (data <= 0x5A)).astype(np.uint8) * np.uint8(32)


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words, by the place of the first."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        total = total * _BASE + h[i : len(h) - k + 1 + i]
    return mix(total)


def arrow_type(spark_type: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(spark_type))


# ------------------------------------------------------------- distributed ranks

#: Rows that a bucket of a large cell is meant to hold, the rows from which a cell is
#: large, and the most large cells that are broadcast (more: a join).
BUCKET_ROWS, LARGE_CELL, MOST_LARGE = 1_000, 20_000, 200_000


def ranked(df: DataFrame, cell: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Adds `name`: each row's place, from 0, among the rows of its cell.

    Rows go by the hash of `order`, then by `order`.  Rows of a large cell are
    spread over hash buckets, buckets are counted with map-side sums, and only
    rows of one bucket are sorted together, so a cell may hold any share of all
    rows.  Rows that agree on `order` are alike for the caller.
    """
    kept = df.columns
    large = materialize(df.groupBy(*[F.col(c).alias(f"_l{i}") for i, c in enumerate(cell)]).agg(F.count("*").alias("_n")).where(F.col("_n") > LARGE_CELL), "rank-large")
    few = large.count() <= MOST_LARGE
    same = [F.col(c).eqNullSafe(F.col(f"_l{i}")) for i, c in enumerate(cell)]
    df = df.join(F.broadcast(large) if few else large, functools.reduce(operator.and_, same), "left")
    h = F.xxhash64(*order)
    buckets = F.coalesce(F.ceil(F.col("_n") / BUCKET_ROWS), F.lit(1))
    df = df.select(*kept, h.alias("_h"), F.pmod(h, buckets).alias("_b"), F.col("_n").isNotNull().alias("_large"))
    counts = df.where("_large").groupBy(*cell, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*cell).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for BUCKET_ROWS rows
    counts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    counts = counts.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate([*cell, "_b"])], "_start")
    on = functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"_c{i}")) for i, c in enumerate([*cell, "_b"])])
    within = Window.partitionBy(*cell, "_b").orderBy("_h", *order)
    placed = df.withColumn("_w", F.row_number().over(within) - 1)
    joined = placed.join(counts, on, "left")
    return joined.select(*kept, (F.coalesce("_start", F.lit(0)) + F.col("_w")).cast("long").alias(name))


# ---------------------------------------------------------- connected components


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (a, b); root is the smallest node reachable.

    Alternates large-star and small-star steps; each step's edges are written to
    the shared folder, only counts reach the driver, and steps go on until the
    edges no longer change.
    """
    current = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    if current.isEmpty():
        return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    seen = None
    for _ in range(rounds):
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that the joins below read plain exchanges, which Spark can split where a node has many edges
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{name}-least")
        large = materialize(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), f"{name}-large")
        smaller = materialize(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-small")
        small = large.join(smaller, "a").where("b <> m").select(F.col("m").alias("b"), F.col("b").alias("a"))
        stepped = small.select("a", "b").union(smaller.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        last, current = current, materialize(stepped.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), name)
        sums = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(last, least, large, smaller)
        if seen == tuple(sums):
            break
        seen = tuple(sums)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
