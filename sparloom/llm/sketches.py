"""Document fingerprints: threshold-scaled sketches of word shingles.

A text's sketch holds every hash of its FIVE-word shingles below a fixed
fraction (1 / SCALE) of the hash range.  As the threshold is the same for all
texts, sketches of very unequal texts compare without bias, and the sketch of
several texts together is the union of theirs.  The likeness of two sketches is
the estimated containment of the smaller in the larger: shared hashes over the
hashes of the smaller.

A fingerprint shows the sketch: its hashes in ascending order, 16 lowercase hex
digits each.  Equal texts have equal fingerprints.

Defined cases: a null text counts as empty; a text without words has an empty
fingerprint; one of fewer than five words has one shingle, all its words; where
no hash is below the threshold, the smallest one stands in, so that likeness is
defined (merging drops such stand-ins once a hash below it is there).  Two empty
fingerprints have likeness 1, an empty one and another 0.  Rows go by id, rows
without id first, rows of equal ids by the hash of their texts; ids may be of any
type that has an order.  Rows of equal id and text follow each other.  An empty
table stays empty; other columns of the input take no part.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import discard, materialize, mix, read_table, run_hashes, steps, utf8, word_hashes, words

FIVE = 5
SCALE = 8
THRESHOLD = np.uint64((1 << 64) // SCALE)
#: Rows that a block of consecutive ids is meant to hold, and blocks at most.
BLOCK_ROWS, MAX_BLOCKS = 2_000, 20_000


def shingles(at: np.ndarray, data: np.ndarray, k: int = FIVE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of all rows, and each row's first (rows + 1)."""
    begin, end, first = words(at, data)
    h = word_hashes(data, begin, end)
    runs = run_hashes(h, k)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    inside = row[: len(runs)] == row[k - 1 :] if len(runs) else np.zeros(0, bool)
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < k))
    extra = [mix(run_hashes(h[first[i] : first[i] + n[i]], int(n[i])) + np.uint64(n[i])) for i in short]
    value = np.concatenate([runs[inside], *extra]) if len(short) else runs[inside]
    owner = np.concatenate([row[: len(runs)][inside], short]) if len(short) else row[: len(runs)][inside]
    if len(short):
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    return value, np.searchsorted(owner, np.arange(len(at)))


def sketches(at: np.ndarray, data: np.ndarray) -> list[np.ndarray]:
    """Each row's sketch: sorted hashes below the threshold, else the smallest."""
    value, first = shingles(at, data)
    low = value < THRESHOLD
    picked, place = value[low], np.concatenate(([0], np.cumsum(low)))[first]
    out = []
    for a, b, i, j in zip(first[:-1], first[1:], place[:-1], place[1:], strict=True):
        out.append(np.unique(picked[i:j]) if j > i else value[a:b].min(keepdims=True) if b > a else picked[:0])
    return out


def shown(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def parsed(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


def merged(*found: np.ndarray) -> np.ndarray:
    """The sketch of all the texts together."""
    union = np.unique(np.concatenate(found))
    low = union[union < THRESHOLD]
    return low if len(low) else union[:1]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate((a, b))
    both.sort()
    return float((both[1:] == both[:-1]).sum()) / min(len(a), len(b))


def _packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return utf8(pa.array(texts, pa.large_string()))


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of each row's text; replaces a column of that name."""
    kept = docs.drop(name) if name != text else docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, text):
                found = [shown(s) for s in sketches(*utf8(step.column(text)))]
                yield pa.RecordBatch.from_arrays([*step.columns, pa.array(found, pa.string())], [*step.schema.names, name])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, *StructType.fromDDL(f"`{name}` string").fields]))


def _numbers(bounds: list[tuple]):
    """A function of (id, hash): 2 * block, one more for the place that begins it; bounds: ascending places.

    Bounds are searched as an array where ids are whole numbers, else as tuples;
    so are places whose id is that of a bound, which the hash decides.
    """
    shown = [(k is not None, k if k is not None else 0, h) for k, h in bounds]
    whole = all(isinstance(k, int) for k, _ in bounds[1:])
    low = [k if isinstance(k, int) else -(1 << 63) for k, _ in bounds] if whole else []

    def number(key, h: int) -> int:
        place = key is not None, key if key is not None else 0, h
        at = max(bisect.bisect_right(shown, place) - 1, 0)
        return 2 * at + (shown[at] == place)

    def find(keys: pa.Array, hashes: pa.Array) -> pa.Array:
        if not whole or keys.null_count or not pa.types.is_integer(keys.type):
            return pa.array([number(k, h) for k, h in zip(keys.to_pylist(), hashes.to_pylist(), strict=True)], pa.int64())
        own, ends = np.asarray(keys, np.int64), np.array(low, np.int64)
        at = np.searchsorted(ends, own, "right") - 1
        out = 2 * np.maximum(at, 0)
        for i in np.flatnonzero((at < 0) | (ends[np.maximum(at, 0)] == own)):
            out[i] = number(int(own[i]), hashes[int(i)].as_py())
        return pa.array(out, pa.int64())

    return find


def in_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (block, halo, key, text), a partition's blocks in order of places.

    A place is (id, hash of the text).  Blocks are ranges of places; the first
    rows of each also end the block before it (halo 1), those of all the last
    block, so each row's follower is beside it.  Texts are shuffled once.  Block
    bounds are at most MAX_BLOCKS places, which go to executors as one broadcast.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), value.alias("text"), F.xxhash64(value).alias("h"))
    places = materialize(rows.select(F.struct("key", "h").alias("place")), "sketch-places")  # narrow; texts are read here and where they are shuffled
    blocks = max(1, min(MAX_BLOCKS, places.count() // BLOCK_ROWS))
    first = places.repartitionByRange(blocks, "place").groupBy(F.spark_partition_id()).agg(F.min("place").alias("place"))
    found = [tuple(r[0]) for r in first.select("place").orderBy("place").collect()]  # MAX_BLOCKS places
    discard(places)
    n = len(found)
    held = docs.sparkSession.sparkContext.broadcast(found)

    def told(keys: pa.Array, hashes: pa.Array) -> pa.Array:
        if "find" not in kept:  # once a task
            kept["find"] = _numbers(held.value)
        return kept["find"](keys, hashes)

    kept: dict = {}
    rows = rows.withColumn("number", F.arrow_udf(told, "long")(F.col("key"), F.col("h")))
    block, begins = F.floor(F.col("number") / 2).cast("int"), F.col("number") % 2 == 1
    own = F.struct(block.alias("block"), F.lit(0).alias("halo"))
    before = F.struct(F.when(block == 0, max(n, 1) - 1).otherwise(block - 1).alias("block"), F.lit(1).alias("halo"))
    where = F.when(begins, F.array(own, before)).otherwise(F.array(own))
    rows = rows.select("key", "text", "h", F.explode(where).alias("p")).select("p.block", "p.halo", "key", "text", "h")
    return rows.repartition(max(n, 1), "block").sortWithinPartitions("block", "halo", "key", "h").drop("h")


def edited(text: str, following: str) -> str:
    """The last quarter of a text's characters replaced by as many first ones of another."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n] if n else text


def compared(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's fingerprint beside that of its edited form and of the next text."""

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(docs.schema[key].dataType)

    def block(rows: list[tuple[int, int, str]]) -> pa.RecordBatch | None:
        """Of consecutive rows (halo, key, text): all but the last, which only follows."""
        mine = [i for i in range(len(rows) - 1) if rows[i][0] == 0]
        if not mine:
            return None
        texts = [t for _, _, t in rows]
        changed = [edited(texts[i], texts[i + 1]) for i in mine]
        own, other = sketches(*_packed(texts)), sketches(*_packed(changed))
        columns = [
            pa.array([rows[i][1] for i in mine], kind),
            pa.array([len(texts[i]) for i in mine], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            pa.array([shown(own[i]) for i in mine], pa.string()),
            pa.array([shown(s) for s in other], pa.string()),
            pa.array([likeness(own[i], s) for i, s in zip(mine, other, strict=True)], pa.float64()),
            pa.array([likeness(own[i], own[i + 1]) for i in mine], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, str]] = []
        at = None
        for batch in batches:
            for step in steps(batch, "text"):
                for b, halo, k, t in zip(*(step.column(c).to_pylist() for c in ("block", "halo", "key", "text")), strict=True):
                    if b != at:
                        if (out := block(held)) is not None:
                            yield out
                        held, at = [], b
                    held.append((halo, k, t))
                if (out := block(held)) is not None:
                    yield out
                held = held[-1:]
        if (out := block(held)) is not None:
            yield out

    schema = f"key {docs.schema[key].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_blocks(docs, key, text).mapInArrow(run, schema).withColumnRenamed("key", key)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(read_table(spark, sf_dir, "documents"))
