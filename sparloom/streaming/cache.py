"""A semantic cache as a stateful stream.

Entries are dealt to cells by hash; a question visits every cell, where a matrix
product with the cell's entries finds the nearest, and the visits' best decides.  An
equal text is an exact hit with score 1, else an entry of a cosine of `threshold` or
more is a near hit.  What misses is answered and put: the verdicts of a micro-batch
write their puts as a file of the stream's second source, so the next micro-batch
brings them to their cells.  Each micro-batch reads before it puts; with one question
a micro-batch the stream is the sequential cache.

A cell holds blocks of entries (hashed token counts) in map state, so a put touches
one block.  Entries
end `ttl` after they were put, by the questions' own times; as every question visits
every cell, blocks whose entries all have ended are dropped then, without timers.
A retried micro-batch writes the same folders anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import tokens
from ..operators.nearness import counted
from ..operators.retrieval import Tokens
from ..session import by_value

#: Entries of a block of a cell's state.
BLOCK = 256
#: Questions of a micro-batch whose vectors are unpacked at once in a cell.
QUESTIONS = 1_024
ASKED = "qid long, at long, text string"
PUT = ASKED + ", answer string"
VERDICT = "qid long, at long, kind string, score double, seq long, answer string"
VISIT = "cell int, put boolean, qid long, at long, text string, digest string, vector binary"
FOUND = "qid long, at long, text string, exact boolean, score double, seq long"
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


by_value(__name__)


class Cell(StatefulProcessor):
    """One cell: blocks of entries (number, end, digest, vector), and the exact texts' latest entries."""

    def __init__(self, ttl: int | None, dim: int) -> None:
        self.ttl, self.dim = ttl, dim

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.blocks = handle.getMapState("blocks", "number long", "seqs binary, ends binary, vectors binary")
        self.exact = handle.getMapState("exact", "digest string", "seq long, end long")
        self.last = handle.getValueState("last", "number long")

    def put(self, rows: pd.DataFrame) -> None:
        number = self.last.get()[0] if self.last.exists() else 0
        held = self.blocks.getValue((number,)) if self.blocks.containsKey((number,)) else (b"", b"", b"")
        seqs, ends, vectors = (list(np.frombuffer(x, kind)) for x, kind in zip(held, (np.int64, np.int64, np.int32), strict=True))
        for row in rows.itertuples(index=False):
            end = row.at + self.ttl if self.ttl is not None else np.iinfo(np.int64).max
            if len(seqs) == BLOCK:
                self.blocks.updateValue((number,), self._packed(seqs, ends, vectors))
                number, seqs, ends, vectors = number + 1, [], [], []
            seqs.append(row.qid)
            ends.append(end)
            vectors.extend(np.frombuffer(row.vector, np.int32))
            self.exact.updateValue((row.digest,), (int(row.qid), int(end)))
        self.blocks.updateValue((number,), self._packed(seqs, ends, vectors))
        self.last.update((number,))

    def _unit(self, raw: bytes) -> np.ndarray:
        counts = np.frombuffer(raw, np.int32).reshape(-1, self.dim).astype(float)
        return counts / np.maximum(np.sqrt((counts * counts).sum(axis=1, keepdims=True)), 1e-300)

    @staticmethod
    def _packed(seqs: list, ends: list, vectors: list) -> tuple[bytes, bytes, bytes]:
        return np.array(seqs, np.int64).tobytes(), np.array(ends, np.int64).tobytes(), np.array(vectors, np.int32).tobytes()

    def ask(self, rows: pd.DataFrame) -> pd.DataFrame:
        at, vectors = rows["at"].to_numpy(np.int64), rows["vector"].to_numpy()
        best, seq = np.full(len(rows), -np.inf), np.full(len(rows), -1, np.int64)
        ended = []
        for (number,), held in self.blocks.iterator():
            seqs, ends = np.frombuffer(held[0], np.int64), np.frombuffer(held[1], np.int64)
            if (ends < at.min()).all():
                ended.append(number)
                continue
            order = np.argsort(seqs, kind="stable")  # of equal scores the earliest entry
            seqs, ends, entries = seqs[order], ends[order], self._unit(held[2])[order].T
            for i in range(0, len(rows), QUESTIONS):  # a block is read once; only some questions are unpacked beside it
                part = slice(i, i + QUESTIONS)
                score = np.round(self._unit(b"".join(vectors[part])) @ entries, 6)
                score[ends[None, :] < at[part, None]] = -np.inf
                top = np.argmax(score, axis=1)
                value = score[np.arange(len(score)), top]
                better = (value > best[part]) | (value == best[part]) & (value > -np.inf) & (seqs[top] < seq[part])
                best[part], seq[part] = np.where(better, value, best[part]), np.where(better, seqs[top], seq[part])
        for number in ended:
            self.blocks.removeKey((number,))
        exact = []
        for digest, when in zip(rows["digest"], at.tolist(), strict=True):
            found = self.exact.getValue((digest,)) if self.exact.containsKey((digest,)) else None
            if found and found[1] < when:
                self.exact.removeKey((digest,))
                found = None
            exact.append(found[0] if found else None)
        same = np.array([x is not None for x in exact])
        seq = np.where(same, [x if x is not None else 0 for x in exact], seq)
        out = pd.DataFrame({"qid": rows["qid"], "at": rows["at"], "text": rows["text"], "exact": same, "score": np.where(same, 1.0, np.maximum(best, -2.0)), "seq": seq})
        return out[same | (best > -np.inf) | rows["text"].notna()]  # a question's own cell tells of it at any rate

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        given = pd.concat(list(rows))
        puts = given[given["put"]].sort_values(["at", "qid"])
        if len(puts):
            self.put(puts)
        asked = given[~given["put"]]
        if len(asked):
            yield self.ask(asked)


def visits(asked: DataFrame, cells: int, put: bool, dim: int = 384) -> DataFrame:
    """Rows (VISIT) of questions (qid, at, text): to all cells, or as puts to their own.  The visit to a question's own cell carries its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = counted(Tokens(b.column(4)), dim).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([c.tobytes() for c in counts], pa.binary())], ["qid", "at", "text", "digest", "vector"])

    rows = asked.select("qid", "at", "text", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), tokens(F.col("text")).alias("t"))
    made = rows.mapInArrow(run, ASKED + ", digest string, vector binary")
    made = made.withColumn("home", F.pmod(F.xxhash64("digest"), F.lit(cells)).cast("int"))
    made = made.withColumn("cell", F.col("home") if put else F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    own = F.col("cell") == F.col("home")
    return made.select("cell", F.lit(put).alias("put"), "qid", "at", F.when(own, F.coalesce("text", F.lit(""))).alias("text"), "digest", "vector")


Answer = Callable[[DataFrame], DataFrame]


def hashed_answers(missed: DataFrame) -> DataFrame:
    """(qid, answer) of (qid, at, text): a digest that stands in for a generator."""
    return missed.select("qid", F.substring(F.md5("text"), 1, 16).alias("answer"))


def decided(found: DataFrame, threshold: float) -> DataFrame:
    """(qid, at, text, kind, score, seq) of each question from its visits' findings (FOUND)."""
    best = F.max(F.struct("exact", "score", (-F.col("seq")).alias("back")))
    told = found.groupBy("qid", "at").agg(F.max("text").alias("text"), best.alias("b"))
    kind = F.when(F.col("b.exact"), "exact").when(F.col("b.score") >= threshold, "near").otherwise("miss")
    told = told.select("qid", "at", "text", kind.alias("kind"), F.greatest("b.score", F.lit(0.0)).alias("score"), (-F.col("b.back")).alias("seq"))
    return told.withColumn("seq", F.when(F.col("kind") != "miss", F.col("seq")))


class Cache:
    """A cache over questions that arrive by folders; its verdicts and entries are Parquet folders.

    root/asked     batch=N: questions (qid, at, text); serve() answers what is new in one micro-batch
    root/verdicts  batch=N: qid, at, kind, score, seq (of the entry), answer
    root/puts      batch=N: what missed, with its answer: the entries
    root/state     the stream's checkpoint: another Cache over the same root goes on from it
    """

    def __init__(self, spark: SparkSession, root: str, cells: int = 8, threshold: float = 0.92, ttl: int | None = None, answer: Answer = hashed_answers, dim: int = 384) -> None:
        self.spark, self.root, self.cells, self.threshold, self.ttl, self.answer, self.dim = spark, root, cells, threshold, ttl, answer, dim
        for folder, schema in (("asked", ASKED), ("puts", PUT)):
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{root}/{folder}/batch=-1")

    def arrive(self, asked: DataFrame, number: int) -> None:
        asked.select("qid", "at", "text").write.mode("overwrite").parquet(f"{self.root}/asked/batch={number}")

    def serve(self) -> None:
        """Runs the stream until every question that arrived has its verdict and every put its cell."""
        found = [visits(self._stream(f, s), self.cells, put, self.dim) for f, s, put in (("asked", ASKED, False), ("puts", PUT, True))]
        cells = found[0].unionByName(found[1]).groupBy("cell").transformWithStateInPandas(Cell(self.ttl, self.dim), FOUND, "Append", "None")
        before = self.spark.conf.get(ROCKS[0])
        self.spark.conf.set(*ROCKS)
        try:
            job = cells.writeStream.foreachBatch(self._decide).option("checkpointLocation", f"{self.root}/state").start()
            try:
                job.processAllAvailable()
            finally:
                job.stop()
        finally:
            self.spark.conf.set(ROCKS[0], before)

    def _stream(self, folder: str, schema: str) -> DataFrame:
        return self.spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.root}/{folder}")

    def verdicts(self) -> DataFrame:
        return self.spark.read.schema(VERDICT).option("recursiveFileLookup", True).parquet(f"{self.root}/verdicts")

    def entries(self) -> DataFrame:
        return self.spark.read.schema(PUT).option("recursiveFileLookup", True).parquet(f"{self.root}/puts")

    def _decide(self, found: DataFrame, number: int) -> None:
        """A micro-batch's verdicts and puts; a retry writes the same folders anew."""
        found = found.persist()
        told = decided(found, self.threshold).persist()
        missed = told.where("kind = 'miss'").select("qid", "at", "text")
        made = missed.join(self.answer(missed), "qid", "left").select("qid", "at", "text", "answer").persist()
        held = self.entries().select(F.col("qid").alias("seq"), "answer")
        hits = told.where("kind <> 'miss'").join(held, "seq").select("qid", "at", "kind", "score", "seq", "answer")
        rows = hits.union(told.where("kind = 'miss'").join(made.select("qid", "answer"), "qid").select("qid", "at", "kind", "score", "seq", "answer"))
        rows.write.mode("overwrite").parquet(f"{self.root}/verdicts/batch={number}")
        if not made.isEmpty():  # an empty file would call for one more micro-batch
            made.write.mode("overwrite").parquet(f"{self.root}/puts/batch={number}")
        for df in (made, told, found):
            df.unpersist()
