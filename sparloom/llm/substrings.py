"""Removal of repeated passages, with a count-min prefilter.

A window is WINDOW consecutive words of one document; words covered by a window
that also starts in a document with a smaller id are removed.

Prefilter.  A window's sketch key is the least hash among its GRAM-word runs, so
equal windows share their key and consecutive windows mostly do too: a document
has about two runs of windows with one key for every WINDOW - GRAM words.  The
sketch is a count-min table of ROWS rows of `width` counters; width is LOAD times
the number of runs, as a power of two.  Each task counts the runs of its
documents, one counter a row for each run, and sends its counters by slices of
SLICE; equal slices are merged by sums.  A key's estimate is the least of its
counters, which is never below the number of runs with it, hence never below the
number of documents with any one of their windows: nothing repeated is lost.
Only counters of 2 and more leave the table; the table itself is never gathered,
so it may grow with the input.

Second pass.  Only windows of keys estimated at 2 or more are hashed as a whole
(128 bits of their words) and grouped exactly, by sums before shuffles; the least
ids of repeated windows are written first, so that rows of a frequent window meet
theirs in a join that Spark can split.  Documents whose words all equal an
earlier document's need no windows: they are removed whole, and only the first of
such copies takes part.

Defined cases: null and empty texts have no words (kept_sha256 of the empty
string); ids equal in several rows never remove each other's words; rows without
id count as the smallest id; ids that are no whole numbers raise an error; an
empty table stays empty; other columns of the input take no part.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import discard, materialize, mix, read_table, run_hashes, steps, utf8, word_hashes, words

WINDOW, GRAM = 50, 16
#: Rows of the count-min table, counters of a row for each run, and counters of a slice.
ROWS, LOAD, SLICE = 2, 8, 1 << 22
NO_ID = -(1 << 63)


def _sliding_least(a: np.ndarray, n: int) -> np.ndarray:
    """Least of each n consecutive values."""
    if len(a) < n:
        return a[:0]
    held, out = 1, a
    while 2 * held <= n:
        out = np.minimum(out[: len(out) - held], out[held:])
        held *= 2
    rest = n - held
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def window_cells(at: np.ndarray, data: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of all rows: row, key, first and end window of each run of windows with one cell; words of each row."""
    begin, end, first = words(at, data)
    n = np.diff(first)
    least = _sliding_least(run_hashes(word_hashes(data, begin, end), gram), window - gram + 1)
    row = np.repeat(np.arange(len(n)), n)[: len(least)]
    place = np.arange(len(least)) - first[row]
    valid = np.flatnonzero(place + window <= n[row]) if len(least) else np.zeros(0, np.int64)
    row, place, cell = row[valid], place[valid], mix(least[valid]).view(np.int64)
    fresh = np.ones(len(cell), bool)
    fresh[1:] = (cell[1:] != cell[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(fresh)
    stop = np.append(start[1:], len(cell))[: len(start)] - 1
    return row[start], cell[start], place[start], place[stop] + 1, n


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _cells(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "text"):
                at, data = utf8(step.column("text"))
                row, cell, start, stop, n = window_cells(at, data, window, gram)
                counts = np.bincount(row, minlength=len(n))
                whole = data.tobytes()
                texts = [hashlib.md5(b" ".join(whole[a:b].split())).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([step.column("k"), step.column("h"), pa.array(texts, pa.string()), pa.array(n, pa.int32()), _lists(cell, counts, pa.int64()), _lists(start, counts, pa.int32()), _lists(stop, counts, pa.int32())], ["k", "h", "same", "n", "cells", "starts", "stops"])

    return run


class Sketch:
    """A count-min table that is kept in slices: counter numbers of keys, and how slices are filled and merged."""

    def __init__(self, runs: int) -> None:
        self.bits = int(np.ceil(np.log2(max(64, LOAD * runs))))
        self.width = 1 << self.bits

    def counters(self, keys: np.ndarray) -> list[np.ndarray]:
        """Of each row of the table, the counter of each key: other bits of the key for each row."""
        bits = keys.view(np.uint64)
        low, high = bits & np.uint64(self.width - 1), bits >> np.uint64(64 - self.bits)
        return [low.astype(np.int64), high.astype(np.int64) + self.width]

    def columns(self, key: str) -> list[F.Column]:
        """The same as columns."""
        return [F.col(key).bitwiseAND(self.width - 1), F.shiftrightunsigned(F.col(key), 64 - self.bits) + self.width]

    def fill(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of one task: its counters (lists of keys), packed by slices."""
        held: list[np.ndarray] = []
        for batch in batches:
            held += self.counters(np.asarray(batch.column(0).flatten()).astype(np.int64))
            if sum(map(len, held)) > SLICE:
                yield from self._packed(*np.unique(np.concatenate(held), return_counts=True))
                held = []
        if held:
            yield from self._packed(*np.unique(np.concatenate(held), return_counts=True))

    @staticmethod
    def _packed(at: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        number = at // SLICE
        cuts = np.flatnonzero(np.diff(number)) + 1
        for i, c in zip(np.split(at, cuts), np.split(n, cuts), strict=True):
            if len(i):
                place = np.diff(i % SLICE, prepend=0).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array([i[0] // SLICE], pa.int64()), pa.array([zlib.compress(place.tobytes(), 1)], pa.binary()), pa.array([np.minimum(c, 255).astype(np.uint8).tobytes()], pa.binary())], ["slice", "place", "n"])

    @staticmethod
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in order of slices: the counters of 2 and more of each merged slice."""

        def told(at: int, total: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total > 1) + at * SLICE, pa.int64())], ["counter"])

        at, total = None, np.zeros(SLICE, np.uint8)
        for batch in batches:
            for number, place, n in zip(*(batch.column(c) for c in ("slice", "place", "n")), strict=True):
                if number.as_py() != at:
                    if at is not None:
                        yield told(at, total)
                    at, total = number.as_py(), np.zeros(SLICE, np.uint8)
                i = np.cumsum(np.frombuffer(zlib.decompress(place.as_py()), np.uint32).astype(np.int64))
                total[i] = np.minimum(total[i].astype(np.int64) + np.frombuffer(n.as_py(), np.uint8), 255)
        if at is not None:
            yield told(at, total)

    def repeated(self, keys: DataFrame) -> DataFrame:
        """(counter) of all counters that reach 2 over the lists of keys."""
        pieces = keys.mapInArrow(self.fill, "slice long, place binary, n binary")
        merged = pieces.repartition("slice").sortWithinPartitions("slice").mapInArrow(Sketch.merge, "counter long")
        return materialize(merged, "substring-counters")


def _windows(window: int):
    """Whole-window hashes of the estimated repeats (starts, stops) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for step in steps(batch, "text"):
                for k, h, text, runs in zip(*(step.column(c) for c in ("k", "h", "text", "runs")), strict=True):
                    found = text.as_py().encode().split()
                    line = b" ".join(found)
                    end = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
                    begin = np.concatenate(([0], end[:-1] + 1))
                    where = np.unique(np.concatenate([np.arange(r["starts"], r["stops"]) for r in runs.as_py()]))
                    hashed = b"".join([digest(line[i:j]) for i, j in zip(begin[where].tolist(), end[where + window - 1].tolist(), strict=True)])
                    del line, found
                    pair = np.frombuffer(hashed, ">i8").astype(np.int64).reshape(-1, 2)
                    m = len(where)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, k.as_py(), np.int64)), pa.array(np.full(m, h.as_py(), np.int64)), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(where.astype(np.int32))], ["k", "h", "w1", "w2", "start"])

    return run


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in itertools.chain.from_iterable(steps(b, "text") for b in batches):
            n, gone, sha, kept = [], [], [], []
            for text, whole, starts in zip(batch.column("text"), batch.column("whole"), batch.column("starts"), strict=True):
                found = text.as_py().encode().split()
                covered = np.zeros(len(found) + 1, np.int64)
                if whole.as_py():
                    covered[0] = 1
                elif starts.as_py():
                    where = np.unique(np.asarray(starts.as_py(), np.int64))
                    covered[where] += 1
                    covered[where + window] -= 1
                removed = np.cumsum(covered[:-1]) > 0
                n.append(len(found))
                gone.append(int(removed.sum()))
                left = b" ".join(found) if not gone[-1] else b" ".join([w for w, r in zip(found, removed.tolist(), strict=True) if not r])
                kept.append(left)
                sha.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("h"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())], ["k", "h", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """key, n_words, n_removed, kept_sha256 and kept_text (kept words joined by a blank) of each row."""
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} must be a whole number; the smaller one keeps its words")
    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("k"), F.xxhash64(value).alias("h"), value.alias("text"))
    told = rows.mapInArrow(_cells(window, gram), "k long, h long, same string, n int, cells array<long>, starts array<int>, stops array<int>")
    told = materialize(told, "substring-cells")
    least = materialize(told.where(F.col("n") >= window).groupBy("same").agg(F.min("k").alias("least"), F.count("*").alias("c")).where("c > 1").drop("c"), "substring-copies")
    copies = materialize(told.select("k", "h", "same").join(least, "same").where("k > least").select("k", "h").distinct(), "substring-late")
    active = materialize(told.join(least, "same", "left").where("least is null or k = least").select("k", "h", "cells", "starts", "stops"), "substring-runs")
    discard(told, least)
    sketch = Sketch(active.agg(F.sum(F.size("cells"))).first()[0] or 0)
    counters = sketch.repeated(active.select("cells"))
    runs = active.select("k", "h", F.explode(F.arrays_zip("cells", "starts", "stops")).alias("r")).select("k", "h", F.col("r.cells").alias("cell"), F.col("r.starts").alias("starts"), F.col("r.stops").alias("stops"))
    for counter in sketch.columns("cell"):  # a run stays if all its counters do
        runs = runs.withColumn("counter", counter).join(counters, "counter", "left_semi").drop("counter")
    repeated = materialize(runs.groupBy("k", "h").agg(F.collect_list(F.struct("starts", "stops")).alias("runs")), "substring-repeats")
    discard(active, counters)
    windows = rows.join(repeated, ["k", "h"]).select("k", "h", "text", "runs")
    found = materialize(windows.mapInArrow(_windows(window), "k long, h long, w1 long, w2 long, start int"), "substring-windows")
    first = materialize(found.groupBy("w1", "w2").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo < hi").drop("hi"), "substring-first")
    late = found.join(first, ["w1", "w2"]).where("k > lo").groupBy("k", "h").agg(F.collect_list("start").alias("starts"))
    gone = late.select("k", "h", F.lit(False).alias("whole"), "starts").union(copies.select("k", "h", F.lit(True), F.array().cast("array<int>")))
    gone = materialize(gone, "substring-gone")
    discard(repeated, found, first, copies)
    out = rows.join(gone, ["k", "h"], "left").select("k", "h", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "starts")
    out = out.mapInArrow(_kept(window), "k long, h long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out.select(F.when(F.col("k") != NO_ID, F.col("k")).alias(key), "n_words", "n_removed", "kept_sha256", "kept_text")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read_table(spark, sf_dir, "documents")).drop("kept_text")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
late AS (SELECT doc_id, i FROM win JOIN (SELECT h, min(doc_id) AS lo FROM win GROUP BY h) USING (h) WHERE lo < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM late, (SELECT unnest(range(50)) AS k)),
left_over AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS kept, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM d) ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN left_over USING (doc_id)
"""
