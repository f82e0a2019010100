"""An exact vector index: contiguous cells with centre, radius and norms, of which searches skip most.

The index is written once: vectors are dealt to the nearest of a bounded number of
centres, each cell is a folder of its own, and a table tells every cell's centre, the
greatest distance of its vectors from it, and their greatest norm.  From these follows
the best score that a cell can hold for a query.  A search reads the most promising
cells of each query first, until they hold k vectors; their k-th score then rules out
every cell that cannot reach it.  Only cells that some query needs are read, and in a
cell only the queries that need it are scored.  The rows are those of a full search.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from ..sources.readers import built_once
from .retrieval import HITS, ROWS, Best, _vector_blocks, _vectors, ranked

#: Vectors of a cell (about), and cells at most; centres are drawn from a sample of four vectors a cell.
CELL_ROWS, MOST_CELLS, DRAWN = 256, 4_096, 4
#: Scores are compared when rounded to six digits.
SLACK = 1e-6
STORED = "id long, vector array<float>, cell int"


def _centres(vectors: DataFrame, n: int) -> np.ndarray:
    """Centres from a sample of DRAWN * n vectors (those of least hash), by a few rounds of k-means on the driver."""
    drawn = np.array([r[0] for r in vectors.orderBy(F.xxhash64("id"), "id").select("vector").limit(DRAWN * n).collect()], np.float64)
    centres = drawn[:n].copy()
    for _ in range(5):
        near = np.argmax(drawn @ centres.T - (centres * centres).sum(1) / 2, axis=1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = drawn[near == c].mean(axis=0)
    return centres


def write(vectors: DataFrame, path: str, cells: int | None = None) -> None:
    """Writes the index of vectors (id long, vector array) to path/vectors and path/cells."""
    spark, n = vectors.sparkSession, vectors.count()
    cells = cells or min(MOST_CELLS, max(1, n // CELL_ROWS))
    centres = spark.sparkContext.broadcast(_centres(vectors, cells) if n else np.zeros((1, 1)))  # MOST_CELLS vectors

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centres.value
        for batch in batches:
            v = _vectors(batch.column(1))
            near = np.argmax(v @ c.T - (c * c).sum(1) / 2, axis=1) if len(v) else np.zeros(0, np.int64)
            away = np.sqrt(((v - c[near]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.list_(pa.float32())), pa.array(near.astype(np.int32)), pa.array(away), pa.array(np.sqrt((v * v).sum(axis=1)))], ["id", "vector", "cell", "away", "norm"])

    dealt = vectors.select(F.col("id").cast("long"), "vector").mapInArrow(deal, STORED + ", away double, norm double")
    dealt.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    told = spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"), F.max("norm").alias("norm"))
    where = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres.value)], "cell int, centre array<double>")
    told.join(where, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    spark.range(0).write.mode("append").parquet(path)  # the flag, last


def stored(vectors: DataFrame, cells: int | None = None) -> str:
    """The index folder of vectors (id, vector), built once for their content."""
    return built_once(vectors, ["id", "vector"], f"vector-index-{cells or 0}", lambda given, path: write(given, path, cells))


class Cells:
    """The cells' table, and what they can hold at best."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        rows = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r["cell"])  # MOST_CELLS rows
        self.cell, self.n = np.array([r["cell"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64)
        self.radius, self.norm = np.array([r["radius"] for r in rows]), np.array([r["norm"] for r in rows])
        self.centre = np.array([r["centre"] for r in rows], np.float64)

    def bound(self, q: np.ndarray, metric: str) -> np.ndarray:
        """(queries, cells): no vector of the cell scores more."""
        if metric == "ip":
            length = np.sqrt((q * q).sum(axis=1))[:, None]
            return np.minimum(q @ self.centre.T + length * self.radius, length * self.norm) + SLACK
        away = np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + (self.centre * self.centre).sum(axis=1) - 2 * q @ self.centre.T, 0))
        return -np.maximum(away - self.radius - SLACK, 0) ** 2 + SLACK


def _scored(store: DataFrame, block: tuple[np.ndarray, np.ndarray], wanted: np.ndarray, cell: np.ndarray, k: int, metric: str) -> DataFrame:
    """The k best of each query among its wanted cells; wanted: (queries, cells)."""
    needed = np.flatnonzero(wanted.any(axis=0))
    # a bit for each query and needed cell, not a list of numbers: a task holds 2 MB of them at most
    held = store.sparkSession.sparkContext.broadcast((block, {int(cell[c]): np.packbits(wanted[:, c]) for c in needed}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (qid, q), asking = held.value
        best = Best(len(qid), k)
        for batch in batches:
            of = np.asarray(batch.column(2))
            for c in np.unique(of).tolist():
                some, mine = batch.filter(pa.array(of == c)), np.flatnonzero(np.unpackbits(asking[c], count=len(qid)))
                for i in range(0, some.num_rows, ROWS):
                    part = some.slice(i, ROWS)
                    v, ids, own = _vectors(part.column(1)), np.asarray(part.column(0), np.int64), q[mine]
                    score = own @ v.T
                    score = 2 * score - (own * own).sum(1)[:, None] - (v * v).sum(1)[None, :] if metric == "l2" else score
                    best.add(ids, score, mine)
        at, ids, score = best.reduce()
        yield pa.RecordBatch.from_arrays([pa.array(qid[at.astype(np.int64)], pa.int64()), pa.array(ids.astype(np.int64)), pa.array(score.astype(float))], ["qid", "id", "score"])

    return store.where(F.col("cell").isin([int(cell[c]) for c in needed])).select("id", "vector", "cell").mapInArrow(run, HITS)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, metric: str = "ip", id_col: str = "vec_id", vector: str = "embedding", visited: list[tuple[int, int]] | None = None) -> DataFrame:
    """(qid, id, score, rank) of the k best vectors of each query, as exact_topk gives them.

    visited: gets (cells that were searched, all cells) of each block of queries, summed over its queries.
    """
    store, cells, parts = spark.read.schema(STORED).parquet(f"{path}/vectors"), Cells(spark, path), []
    for block in _vector_blocks(queries, id_col, vector):
        bound = cells.bound(block[1], metric)
        order = np.argsort(-bound, axis=1)
        before = np.cumsum(cells.n[order], axis=1) - cells.n[order]
        first = np.zeros_like(bound, bool)
        np.put_along_axis(first, order, before < k, axis=1)
        found = cut(ranked(_scored(store, block, first, cells.cell, k, metric), k))  # k rows a query
        least = dict(found.groupBy("qid").agg(F.min("score"), F.count("*")).where(F.col("count(1)") == k).select("qid", "min(score)").collect())  # one row a query
        enough = np.array([least.get(int(q), -np.inf) for q in block[0]])
        rest = ~first & (bound >= enough[:, None] - SLACK)
        parts.append(found.select("qid", "id", "score"))
        if rest.any():
            parts.append(_scored(store, block, rest, cells.cell, k, metric))
        if visited is not None:
            visited.append((int((first | rest).sum()), first.size))
    if not parts:
        return spark.createDataFrame([], HITS + ", rank int")
    return ranked(functools.reduce(DataFrame.union, parts), k)
