"""A stored lexical index: postings as Parquet, by segments of rows and sorted by term.

A segment is a run of rows that one task counted: its first row (term '') holds the
rows' ids, lengths and hashed vectors, the others a term's postings each: places of
rows, counts, and for every block of ROW_BLOCK rows the greatest count and the least
length.  These bound a term's part of any score in the block for any k1, b and mean
length, so segments can be appended and nothing is built again.

A search reads the asked terms only (the filter reaches the scan, whose pages are
sorted by term) and scores each segment in the task that reads it: blocks in order
of their bounds, until no bound reaches the k-th score.  k rows a task and query are
shuffled.  Statistics (documents, lengths, document frequencies) are sums over the
segments of the asked terms.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import built_once

#: Rows of a block, and rows and tokens of a segment at most; a segment's file is one row group.
ROW_BLOCK, SEGMENT_ROWS, SEGMENT_TOKENS = 128, 16_384, 4_000_000
#: Terms up to which a search filters by a list that reaches the scan; more are joined.
MOST_LISTED = 64

SCHEMA = "term string, n int, total long, places binary, counts binary, blocks binary, begins binary, most binary, least binary, vectors binary, segment string"
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), 0x5F, *range(0x61, 0x7B)]] = True


def text_tokens(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Lower-cased runs of ASCII letters, digits and underscores of all rows, and each row's number of them."""
    given = pc.replace_substring(pc.fill_null(column.cast(pa.large_string()), ""), "\u0130", "i\u0307")  # its lower case has two characters
    low = pc.utf8_lower(given).cast(pa.large_binary())
    at = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    data = np.frombuffer(low.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    solid = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    begin = np.flatnonzero(solid & (~np.concatenate(([False], solid[:-1])) | edge[:-1]))
    end = np.flatnonzero(solid & (~np.concatenate((solid[1:], [False])) | edge[1:])) + 1
    offsets = np.concatenate(([0], np.cumsum(end - begin)))
    found = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[solid])))
    return found.dictionary_encode(), np.diff(np.searchsorted(begin, at))


def hashed_counts(column: pa.Array, dim: int) -> np.ndarray:
    """(rows, dim): signed counts of each row's tokens by their md5 slots."""
    from .retrieval import _slot

    found, n = text_tokens(column)
    slots = np.array([_slot(t, dim) for t in found.dictionary.to_pylist()], np.int64).reshape(-1, 2)[np.asarray(found.indices, np.int64)]
    at = np.repeat(np.arange(len(n)), n) * dim + slots[:, 0]
    return np.bincount(at, slots[:, 1], len(n) * dim).astype(np.int64).reshape(-1, dim)


# --------------------------------------------------------------------- building


def _binary(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Cells of values[first[i]:first[i + 1]]."""
    offsets = np.asarray(first, np.int64) * values.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _segment(name: str, ids: np.ndarray, lengths: np.ndarray, token: np.ndarray, names: list[str], dim: int) -> Iterator[pa.RecordBatch]:
    """A segment's rows, sorted by term; token: numbers of names, row after row."""
    from .retrieval import _slot

    n_rows = len(ids)
    row = np.repeat(np.arange(n_rows), lengths)
    slots = np.array([_slot(t, dim) for t in names], np.int64).reshape(-1, 2)
    vectors = np.bincount(row * dim + slots[token, 0], slots[token, 1], n_rows * dim).astype(np.int32) if len(token) else np.zeros(n_rows * dim, np.int32)
    widest = max(int(vectors.max(initial=0)), -int(vectors.min(initial=0)))
    vectors = vectors.astype(np.int8 if widest < 1 << 7 else np.int16 if widest < 1 << 15 else np.int32)  # heads are most of what is sorted and written
    order = np.asarray(pc.array_sort_indices(pa.array(names, pa.string())), np.int64)
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    code, count = np.unique(rank[token] * n_rows + row, return_counts=True)
    term, place = np.divmod(code, n_rows)
    first = np.searchsorted(term, np.arange(len(names) + 1))
    block = place // ROW_BLOCK
    start = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])))) if len(term) else np.zeros(0, np.int64)
    of = np.searchsorted(start, first)  # each term's first block
    most = np.maximum.reduceat(count, start) if len(start) else start
    least = np.minimum.reduceat(lengths[place], start) if len(start) else start
    cells = [
        pa.array([names[i] for i in order], pa.string()), pa.array(np.diff(first).astype(np.int32)), pa.nulls(len(names), pa.int64()),
        _binary(place.astype(np.int32), first), _binary(count.astype(np.int32), first),
        _binary(block[start].astype(np.int32), of), _binary((start - np.repeat(first[:-1], np.diff(of))).astype(np.int32), of),
        _binary(most.astype(np.int32), of), _binary(least.astype(np.int32), of), pa.nulls(len(names), pa.binary()), pa.array([name] * len(names), pa.string()),
    ]
    columns = [x.split()[0] for x in SCHEMA.split(", ")]
    head = [[""], [n_rows], [int(lengths.sum())], [ids.astype(np.int64).tobytes()], [lengths.astype(np.int32).tobytes()], [None], [None], [None], [None], [vectors.tobytes()], [name]]
    yield pa.RecordBatch.from_arrays([pa.array(v, c.type) for v, c in zip(head, cells, strict=True)], columns)
    whole = pa.RecordBatch.from_arrays(cells, columns)
    for i in range(0, len(names), 20_000):
        yield whole.slice(i, 20_000)


def append(rows: DataFrame, path: str, dim: int = 384) -> None:
    """Adds the segments of rows (id long, text) to the index folder; a null text has no token."""
    run_name = uuid.uuid4().hex[:12]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        ids, lengths, token, n_rows, n_tokens = [], [], [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            whole = pa.chunked_array(token).unify_dictionaries()
            number = np.concatenate([np.asarray(c.indices, np.int64) for c in whole.chunks])
            yield from _segment(f"{run_name}-{part}-{made}", np.concatenate(ids), np.concatenate(lengths), number, whole.chunk(whole.num_chunks - 1).dictionary.to_pylist(), dim)

        for batch in batches:
            found, n = text_tokens(batch.column(1))
            ids.append(np.asarray(batch.column(0), np.int64))
            lengths.append(n)
            token.append(found)
            n_rows, n_tokens = n_rows + batch.num_rows, n_tokens + len(found)
            if n_rows >= SEGMENT_ROWS or n_tokens >= SEGMENT_TOKENS:
                yield from flush()
                made += 1
                ids, lengths, token, n_rows, n_tokens = [], [], [], 0, 0
        if n_rows:
            yield from flush()

    built = rows.select(F.col("id").cast("long"), "text").mapInArrow(run, SCHEMA).sortWithinPartitions("segment", "term")
    built.write.mode("append").option("parquet.block.size", 1 << 30).option("parquet.page.row.count.limit", 1_000).partitionBy("segment").parquet(path)


def stored(rows: DataFrame, dim: int = 384, like: DataFrame | None = None, name: str = "rows") -> DataFrame:
    """The index of rows (id long, text), built once for their content.

    like: the table that the rows are made from, by steps that `name` tells; its
    content then stands for theirs, so that they need not be made to find the index.
    """
    source = rows.select("id", "text") if like is None else like
    path = built_once(source, source.columns, f"lexical-{name}-{dim}", lambda _, made: append(rows, made, dim))
    return load(rows.sparkSession, path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


# -------------------------------------------------------------------- searching


def hashed_vectors(raw: bytes, rows: int, dim: int) -> np.ndarray:
    """(rows, dim): a head's hashed counts, of the width that their bytes tell."""
    return np.frombuffer(raw, f"i{len(raw) // (rows * dim)}").reshape(rows, dim)


class Terms:
    """A term's postings in a segment."""

    __slots__ = ("begins", "blocks", "bound", "places", "weight")

    def __init__(self, row: dict, norm: np.ndarray, idf: float, k1: float, b: float, average: float) -> None:
        self.places = np.frombuffer(row["places"], np.int32)
        self.blocks, begins, most, least = (np.frombuffer(row[c], np.int32) for c in ("blocks", "begins", "most", "least"))
        self.begins = np.append(begins, len(self.places))
        count = np.frombuffer(row["counts"], np.int32)
        self.weight = idf * (k1 + 1) * count / (count + norm[self.places])
        self.bound = idf * (k1 + 1) * most / (most + k1 * (1 - b + b * least / average))

    def some(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and weights in the wanted blocks."""
        held = np.flatnonzero(wanted[self.blocks])
        if len(held) == len(self.blocks):
            return self.places, self.weight
        size = self.begins[held + 1] - self.begins[held]
        at = np.repeat(self.begins[held] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return self.places[at], self.weight[at]


class Segment:
    """A segment's rows and the postings of asked terms."""

    def __init__(self, head: dict, k1: float, b: float, average: float) -> None:
        self.ids, self.lengths = np.frombuffer(head["places"], np.int64), np.frombuffer(head["counts"], np.int32)
        self.k1, self.b, self.average = k1, b, average
        self.norm = k1 * (1 - b + b * self.lengths / average)
        self.raw, self.terms = head.get("vectors"), {}

    def add(self, number: int, idf: float, row: dict) -> None:
        self.terms[number] = Terms(row, self.norm, idf, self.k1, self.b, self.average)

    def asked(self, query: list[tuple[int, int]]) -> list[tuple[Terms, int]]:
        return [(self.terms[t], times) for t, times in query if t in self.terms]

    def scores(self, query: list[tuple[int, int]], wanted: np.ndarray | None = None) -> np.ndarray:
        """Each row's score; wanted: only in these blocks."""
        out = np.zeros(len(self.ids))
        for term, times in self.asked(query):
            places, weight = (term.places, term.weight) if wanted is None else term.some(wanted)
            out[places] += times * weight
        return out

    def best(self, query: list[tuple[int, int]], k: int, least: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows that may be among the k best, with their scores, and the number of blocks that were left out."""
        bound = np.zeros(-(-len(self.ids) // ROW_BLOCK))
        for term, times in self.asked(query):
            bound[term.blocks] += times * term.bound
        slack = 2e-6  # scores are compared when rounded
        some = bound > max(least - slack, 0)
        if some.sum() > 4:  # a few promising blocks raise the least score
            first = np.zeros(len(bound), bool)
            first[np.argsort(-bound)[:2]] = True
            found = self.scores(query, first)
            found = found[found > 0]
            if len(found) >= k:
                some &= bound >= np.partition(found, -k)[-k] - slack
        out = self.scores(query, some) if some.any() else np.zeros(len(self.ids))
        at = np.flatnonzero(out > 0)
        return at, out[at], int((bound > 0).sum() - some.sum())

    def vectors(self, dim: int) -> np.ndarray:
        """Hashed counts over each row's length; zero rows stay."""
        out = hashed_vectors(self.raw, len(self.ids), dim).astype(float)
        return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-300)


def asked_rows(index: DataFrame, vocabulary: dict[str, int], *columns: str) -> DataFrame:
    """The rows of asked terms and the segments' heads, in order."""
    wanted = ["", *vocabulary]
    if len(wanted) <= MOST_LISTED:
        return index.where(F.col("term").isin(wanted)).select(*columns)
    listed = index.sparkSession.createDataFrame(pa.table({"term": pa.array(wanted, pa.string())}))  # the terms of one block of queries
    return index.join(F.broadcast(listed), "term", "left_semi").select(*columns)


def statistics(index: DataFrame, vocabulary: dict[str, int]) -> tuple[np.ndarray, float]:
    """Each asked term's idf (0 where no row has it), and the rows' mean length."""
    idf, docs, total = np.zeros(max(1, len(vocabulary))), 0, 0
    found = asked_rows(index, vocabulary, "term", "n", "total").groupBy("term").agg(F.sum("n"), F.sum("total")).collect()  # the terms of one block
    for term, n, t in found:
        if term == "":
            docs, total = n, t
    for term, n, _ in found:
        if term:
            idf[vocabulary[term]] = np.log(1 + (docs - n + 0.5) / (n + 0.5))
    return idf, total / max(docs, 1) or 1.0


def segments(batches: Iterator[pa.RecordBatch], vocabulary: dict[str, int], idf: np.ndarray, average: float, k1: float, b: float) -> Iterator[Segment]:
    """Segments of a task's index rows, one at a time."""
    held, name = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["segment"] != name:
                if row["term"] != "":
                    raise ValueError(f"segment {row['segment']} does not begin with its head: its file was split")
                if held:
                    yield held
                held, name = Segment(row, k1, b, average), row["segment"]
            else:
                number = vocabulary[row["term"]]
                held.add(number, idf[number], row)
    if held:
        yield held
