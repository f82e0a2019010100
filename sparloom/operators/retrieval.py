"""Lexical, dense and hybrid retrieval, exact vector search, and a semantic cache."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens
from . import lexical

#: Queries whose vectors and terms are held by tasks at once; more are answered block by block.
QUERY_BLOCK = 4_096
#: Rows that a matrix product scores at once.
ROWS = 512
#: Hits that a task collects before it reduces them to the k best of each query (or four times these, if that is more).
HELD = 1 << 18


# ------------------------------------------------------------ scores of a block of rows


class Best:
    """The k best (score, then smaller id) of each query, kept while rows stream by."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.least = k, np.full(queries, -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.limit = 0, min(64 * queries * k, max(4 * queries * k, HELD)) + 4096

    def add(self, ids: np.ndarray, scores: np.ndarray, mine: np.ndarray | None = None) -> None:
        """scores: (queries, rows), of the queries `mine` or of all; NaN marks pairs that do not count."""
        scores = np.round(scores, 6) + 0.0
        least = self.least if mine is None else self.least[mine]
        if len(ids) > self.k and scores.size > HELD:  # so many would be held at first: no more than the k best of these rows, and equals
            known = np.where(np.isnan(scores), -np.inf, scores)
            least = np.maximum(least, np.partition(known, -self.k, axis=1)[:, -self.k])
        q, at = np.nonzero(scores >= least[:, None])
        self.add_some(q if mine is None else mine[q], ids[at], scores[q, at])

    def add_some(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Of query q[i], row ids[i] with a score that is rounded already."""
        self.held.append((q, ids, scores))
        self.size += len(q)
        if self.size > self.limit:
            self.reduce()

    def reduce(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, ids, scores = (np.concatenate(x) for x in zip(*self.held, strict=True)) if self.held else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        kept = rank < self.k
        q, ids, scores, rank = q[kept], ids[kept], scores[kept], rank[kept]
        self.least[q[rank == self.k - 1]] = scores[rank == self.k - 1]
        self.held, self.size = [(q, ids, scores)], len(q)
        return q, ids, scores


@functools.lru_cache(1 << 18)
def _slot(tok: str, dim: int) -> tuple[int, int]:
    sign = 1 if int(hashlib.md5((tok + "#").encode()).hexdigest()[0], 16) % 2 == 0 else -1
    return int(hashlib.md5(tok.encode()).hexdigest()[:8], 16) % dim, sign


class Tokens:
    """Tokens of rows (a list column) by their distinct strings."""

    def __init__(self, column: pa.Array) -> None:
        flat = column.flatten().dictionary_encode()
        self.names = flat.dictionary.to_pylist()
        self.token = np.asarray(flat.indices, np.int64)
        self.n = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0), np.int64)
        self.row = np.repeat(np.arange(len(self.n)), self.n)

    def hashed(self, dim: int) -> np.ndarray:
        """Signed token counts by slot over each row's length; zero rows stay."""
        slots = np.array([_slot(t, dim) for t in self.names], np.int64).reshape(-1, 2)
        out = np.bincount(self.row * dim + slots[self.token, 0], weights=slots[self.token, 1], minlength=len(self.n) * dim).reshape(-1, dim)
        return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-300)


class Questions:
    """A block of queries: their terms as (number, times), and hashed vectors."""

    def __init__(self, ids: list[int], texts: list[list[str]], dim: int) -> None:
        held = Tokens(pa.array(texts, pa.list_(pa.string())))
        self.ids, self.dim, self.vectors = np.array(ids, np.int64), dim, held.hashed(dim)
        self.vocabulary = {t: i for i, t in enumerate(held.names)}
        self.terms: list[list[tuple[int, int]]] = [[] for _ in ids]
        pairs, times = np.unique(held.row * max(1, len(held.names)) + held.token, return_counts=True)
        for pair, n in zip(pairs.tolist(), times.tolist(), strict=True):
            row, token = divmod(pair, len(held.names))
            self.terms[row].append((token, n))
        self.idf, self.average = np.zeros(0), 1.0

    def dense(self, own: np.ndarray, some: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Cosines with unit rows, and which pairs share a slot."""
        mine = self.vectors[some]
        return mine @ own.T, (mine != 0).astype(np.float32) @ (own != 0).astype(np.float32).T > 0


def _blocks(queries: DataFrame, dim: int) -> Iterator[Questions]:
    """Queries (qid, text) in blocks of QUERY_BLOCK, by a running read that never holds more."""
    ids: list[int] = []
    texts: list[list[str]] = []
    for qid, toks in queries.select("qid", tokens(F.col("text"))).toLocalIterator():
        ids.append(qid)
        texts.append(toks)
        if len(ids) == QUERY_BLOCK:
            yield Questions(ids, texts, dim)
            ids, texts = [], []
    if ids:
        yield Questions(ids, texts, dim)


Scores = Callable[[Questions, Tokens, np.ndarray], np.ndarray]


def _top(chunks: DataFrame, asked: Questions, scores: Scores, k: int) -> DataFrame:
    """(qid, id, score): each task's k best of every query; scores() gives (queries, rows), NaN for pairs that do not count."""
    held = chunks.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(held.value.ids), k)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                some = batch.slice(i, ROWS)
                ids = np.asarray(some.column(0), np.int64)
                best.add(ids, scores(held.value, Tokens(some.column(1)), ids))
        yield _hits(held.value, best)

    return chunks.select(F.col("id").cast("long"), tokens(F.col("text")).alias("t")).mapInArrow(run, HITS)


def _all_blocks(chunks: DataFrame, parts: list[DataFrame], k: int) -> DataFrame:
    if not parts:
        return chunks.sparkSession.createDataFrame([], "qid long, id long, score double, rank int")
    return ranked(functools.reduce(DataFrame.union, parts), k)


HITS = "qid long, id long, score double"


def _hits(asked: Questions, best: Best) -> pa.RecordBatch:
    q, ids, score = best.reduce()
    return pa.RecordBatch.from_arrays([pa.array(asked.ids[q.astype(np.int64)], pa.int64()), pa.array(ids.astype(np.int64)), pa.array(score.astype(float))], ["qid", "id", "score"])


def bm25_topk(chunks: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(qid, id, score, rank): the k chunks (id, text) of the highest BM25 score of each query (qid, text); chunks may be their index.

    Repeated query tokens count as often as they occur; chunks without a token of
    the query have no score.  The chunks are indexed once for their content
    (operators.lexical); each segment is searched in the task that reads it.
    """
    return _all_blocks(chunks, [_searched(index, a, k, k1, b) for index, a in _asked(chunks, queries, 1, k1, b)], k)


def _asked(chunks: DataFrame, queries: DataFrame, dim: int, k1: float, b: float) -> Iterator[tuple[DataFrame, Questions]]:
    """Blocks of queries beside the chunks' index, with statistics of their terms."""
    index = None
    for a in _blocks(queries, dim):
        index = index or (chunks if "term" in chunks.columns else lexical.stored(chunks))
        a.idf, a.average = lexical.statistics(index, a.vocabulary)
        yield index, a


def _searched(index: DataFrame, asked: Questions, k: int, k1: float, b: float) -> DataFrame:
    held = index.sparkSession.sparkContext.broadcast(asked)  # QUERY_BLOCK queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = held.value
        best = Best(len(a.ids), k)
        for segment in lexical.segments(batches, a.vocabulary, a.idf, a.average, k1, b):
            for q, terms in enumerate(a.terms):
                at, score, _ = segment.best(terms, k, best.least[q])
                if len(at):
                    score = np.round(score, 6) + 0.0
                    high = score >= (np.partition(score, -k)[-k] if len(score) > k else -np.inf)
                    best.add_some(np.full(high.sum(), q), segment.ids[at[high]], score[high])
            best.reduce()
        yield _hits(a, best)

    columns = [c for c in index.columns if c not in ("total", "n", "vectors")]
    return lexical.asked_rows(index, asked.vocabulary, *columns).mapInArrow(run, HITS)


def hashed_topk(chunks: DataFrame, queries: DataFrame, k: int, dim: int = 384, earlier: bool = False) -> DataFrame:
    """(qid, id, score, rank) by the cosine of hashing embeddings; earlier: only chunks whose id is below the query's."""
    def scores(asked: Questions, held: Tokens, ids: np.ndarray) -> np.ndarray:
        out, meet = asked.dense(held.hashed(dim))
        return np.where(meet & (ids[None, :] < asked.ids[:, None]) if earlier else meet, out, np.nan)

    return _all_blocks(chunks, [_top(chunks, a, scores, k) for a in _blocks(queries, dim)], k)


#: Queries whose scores of a segment's rows are held at once.
QUERY_ROWS = 64


def hybrid_topk(chunks: DataFrame, queries: DataFrame, k: int, dim: int = 384, weights: tuple[float, float] = (0.65, 0.35), k1: float = 1.5, b: float = 0.75, dense_base: bool = False) -> DataFrame:
    """(qid, id, score, rank): cosine and BM25, each over its greatest absolute score of the query, weighted; chunks may be their index.

    Both come from the chunks' index, which holds the hashed vectors; the greatest
    scores from a first pass over it.  dense_base: every chunk is a candidate,
    those without a common slot or token with score 0.
    """
    def both(asked: Questions, segment: lexical.Segment) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        own = segment.vectors(dim)
        for i in range(0, len(asked.ids), QUERY_ROWS):
            some = slice(i, i + QUERY_ROWS)
            dense, meet = asked.dense(own, some)
            lexic = np.stack([segment.scores(t) for t in asked.terms[some]])
            yield some, dense, lexic, np.ones_like(meet) if dense_base else meet | (lexic > 0)

    parts = []
    columns = ("term", "places", "counts", "blocks", "begins", "most", "least", "vectors", "segment")
    for index, a in _asked(chunks, queries, dim, k1, b):
        held = chunks.sparkSession.sparkContext.broadcast(a)  # QUERY_BLOCK queries
        rows = lexical.asked_rows(index, a.vocabulary, *columns)

        def greatest(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            a = held.value
            top = np.zeros((2, len(a.ids)))
            for segment in lexical.segments(batches, a.vocabulary, a.idf, a.average, k1, b):
                for some, dense, lexic, _ in both(a, segment):
                    top[:, some] = np.maximum(top[:, some], [np.abs(dense).max(axis=1), np.abs(lexic).max(axis=1)])
            yield pa.RecordBatch.from_arrays([pa.array(a.ids), pa.array(top[0]), pa.array(top[1])], ["qid", "d", "l"])

        most = rows.mapInArrow(greatest, "qid long, d double, l double").groupBy("qid").agg(F.max("d"), F.max("l"))
        found = {q: (d, x) for q, d, x in most.collect()}  # one row a query of the block
        tops = np.array([found.get(int(q), (0.0, 0.0)) for q in a.ids]).T

        def run(batches: Iterator[pa.RecordBatch], held=held, tops=tops) -> Iterator[pa.RecordBatch]:
            a = held.value
            best = Best(len(a.ids), k)
            for segment in lexical.segments(batches, a.vocabulary, a.idf, a.average, k1, b):
                for some, dense, lexic, counts in both(a, segment):
                    scaled = [np.divide(x, t[some, None], out=np.zeros_like(x), where=t[some, None] > 0) for x, t in ((dense, tops[0]), (lexic, tops[1]))]
                    score = np.round(np.where(counts, weights[0] * scaled[0] + weights[1] * scaled[1], np.nan), 6) + 0.0
                    q, at = np.nonzero(score >= best.least[some, None])
                    best.add_some(q + some.start, segment.ids[at], score[q, at])
                best.reduce()
            yield _hits(a, best)

        parts.append(rows.mapInArrow(run, HITS))
    return _all_blocks(chunks, parts, k)


def ranked(scores: DataFrame, k: int, by: str = "qid", item: str = "id", score: str = "score", digits: int = 6, ascending: bool = False) -> DataFrame:
    """The k best of each query; rounded scores, then the smaller item, decide."""
    rounded = scores.withColumn(score, F.round(score, digits))
    first = F.col(score).asc() if ascending else F.col(score).desc()
    return rounded.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(first, item))).where(F.col("rank") <= k)


def _vector_blocks(queries: DataFrame, id_col: str, vector: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids: list[int] = []
    found: list[list[float]] = []
    for i, v in queries.select(id_col, vector).toLocalIterator():
        ids.append(i)
        found.append(v)
        if len(ids) == QUERY_BLOCK:
            yield np.array(ids, np.int64), np.array(found, np.float64)
            ids, found = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(found, np.float64)


def _vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "ip", id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(qid, id, rank, score): exact search by blocked matrix products.

    Each task keeps its own k best of every query, so the shuffle has k rows a
    task and query.  metric: 'ip' or 'l2' (score is minus the squared distance).
    Queries go to tasks in blocks of QUERY_BLOCK vectors.
    """
    parts = []
    for block in _vector_blocks(queries, id_col, vector):
        held = vectors.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            qid, q = held.value
            best = Best(len(qid), k)
            for batch in batches:
                for i in range(0, batch.num_rows, ROWS):
                    some = batch.slice(i, ROWS)
                    v = _vectors(some.column(1))
                    score = q @ v.T
                    best.add(np.asarray(some.column(0), np.int64), 2 * score - (q * q).sum(1)[:, None] - (v * v).sum(1)[None, :] if metric == "l2" else score)
            at, ids, score = best.reduce()
            yield pa.RecordBatch.from_arrays([pa.array(qid[at.astype(np.int64)], pa.int64()), pa.array(ids.astype(np.int64)), pa.array(score.astype(float))], ["qid", "id", "score"])

        parts.append(vectors.select(F.col(id_col).cast("long"), vector).mapInArrow(run, "qid long, id long, score double"))
    return _all_blocks(vectors, parts, k)


def neighbours(vectors: DataFrame, queries: DataFrame, least: float, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(qid, near): how many other vectors have an inner product of `least` or more with each query."""
    parts = []
    for block in _vector_blocks(queries, id_col, vector):
        held = vectors.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            qid, q = held.value
            near = np.zeros(len(qid), np.int64)
            for batch in batches:
                for i in range(0, batch.num_rows, ROWS):
                    some = batch.slice(i, ROWS)
                    near += ((np.round(q @ _vectors(some.column(1)).T, 6) >= least) & (np.asarray(some.column(0))[None, :] != qid[:, None])).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(near)], ["qid", "near"])

        parts.append(vectors.select(F.col(id_col).cast("long"), vector).mapInArrow(run, "qid long, near long"))
    if not parts:
        return vectors.sparkSession.createDataFrame([], "qid long, near long")
    return functools.reduce(DataFrame.union, parts).groupBy("qid").agg(F.sum("near").alias("near"))


def cache_lookup(entries: DataFrame, asked: DataFrame, near: DataFrame, threshold: float = 0.92) -> DataFrame:
    """(qid, hit, kind, score, seq): an equal text hits with 1.0, else the best entry of threshold or more.

    entries: seq, text; asked: qid, text; near: qid, id (an entry's seq), score.
    """
    equal = asked.join(entries.groupBy("text").agg(F.min("seq").alias("seq")), "text").select("qid", F.col("seq").alias("equal_seq"))
    best = ranked(near, 1).select("qid", F.col("id").alias("near_seq"), "score")
    return cache_verdict(asked.select("qid").join(equal, "qid", "left").join(best, "qid", "left"), threshold)


def cache_verdict(both: DataFrame, threshold: float = 0.92) -> DataFrame:
    """(qid, hit, kind, score, seq) from the equal entry and the nearest (equal_seq, near_seq, score)."""
    exact = F.col("equal_seq").isNotNull()
    score = F.when(exact, 1.0).otherwise(F.coalesce("score", F.lit(0.0)))
    hit = exact | (score >= threshold)
    kind = F.when(exact, "exact").when(hit, "near").otherwise("miss")
    return both.select("qid", hit.alias("hit"), kind.alias("kind"), score.alias("score"), F.when(exact, F.col("equal_seq")).when(hit, F.col("near_seq")).alias("seq"))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """An upsert's outcome: the last row of each key."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("_r"))
    return last.select(key, "_r.*")


def rank_metrics(hits: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """(qid, top1, hit, rr): where the expected item stands among a query's hits (qid, id, rank)."""
    found = expected.join(hits, (expected["qid"] == hits["qid"]) & (expected["expected"] == hits["id"]) & (hits["rank"] <= k), "left")
    rank = F.col("rank")
    return found.select(expected["qid"], F.coalesce((rank == 1).cast("int"), F.lit(0)).alias("top1"), rank.isNotNull().cast("int").alias("hit"), F.coalesce(1 / rank, F.lit(0.0)).alias("rr"))
