"""Coalescing a stream's rows into flushes of a target size, or of what waited long enough.

A key's rows wait in state.  A flush takes them when `target` rows wait, or `patience`
after the first of them came, by the rows' own times: a row that comes later begins
the next flush, and where none comes a timer on the watermark flushes.  So the
boundaries depend on the rows alone, not on how they fell into micro-batches, as long
as rows come in order of times up to the watermark's delay.

Keys are (shard, piece): pieces split a shard over as many tasks as its rows need.
Where `most` is above the target, a key on which more rows wait in one micro-batch
flushes so many of them together, up to `most`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import by_value
from .cache import ROCKS

#: What waits: a row's number and time in milliseconds.
ROW = "id long, at long"
#: Flushes that are handed out together.
FLUSHES = 4_096
FLUSHED = "shard int, piece int, flush long, place int, cause string, " + ROW


by_value(__name__)


class Buffer(StatefulProcessor):
    """Rows of one (shard, piece) that wait, and the number of the next flush."""

    def __init__(self, target: int, patience: int, most: int) -> None:
        self.target, self.patience, self.most = target, patience, max(target, most)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", ROW)
        self.told = handle.getValueState("told", "waiting int, since long, flush long")  # rows that wait, the first's time, the next number

    def _taken(self, key: tuple, cause: list[str], flush: list[int], size: list[int], ids: np.ndarray, at: np.ndarray) -> pd.DataFrame:
        """Rows of flushes, one after the other, of which each has its number, cause and size."""
        place = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
        return pd.DataFrame({"shard": key[0], "piece": key[1], "flush": np.repeat(flush, size), "place": place, "cause": np.repeat(np.array(cause, object), size), "id": ids, "at": at})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        come = pd.concat(list(rows)).sort_values(["at", "id"])
        ids, at = come["id"].to_numpy(np.int64), come["at"].to_numpy(np.int64)
        waiting, since, flush = self.told.get() if self.told.exists() else (0, 0, 0)
        target = min(self.most, max(self.target, waiting + len(ids)))
        before, held = since if waiting else None, waiting
        cause, size, i = [], [], 0  # of the flushes that are taken; state is touched once, however many they are
        while i < len(ids):
            first = since if waiting else int(at[i])
            full = i + target - waiting
            late = max(i, i + int(np.searchsorted(at[i:full], first + self.patience)))
            j = min(full, late, len(ids))
            if j == len(ids) and waiting + j - i < target:  # they wait on
                since = first
                break
            cause.append("full" if waiting + j - i >= target else "late")
            size.append(waiting + j - i)
            waiting, i = 0, j
        if size:
            if held:
                old = [tuple(r) for r in self.rows.get()]
                self.rows.clear()
            else:
                old = []
            told = [np.concatenate((np.array([r[c] for r in old], np.int64), x[:i])) for c, x in enumerate((ids, at))]
            end = np.cumsum(size)
            for a in range(0, len(size), FLUSHES):
                b = min(a + FLUSHES, len(size))
                some = slice(int(end[a]) - size[a], int(end[b - 1]))
                yield self._taken(key, cause[a:b], list(range(flush + a, flush + b)), size[a:b], told[0][some], told[1][some])
        if i < len(ids):
            self.rows.appendList([(int(x), int(y)) for x, y in zip(ids[i:], at[i:], strict=True)])
        self._wait(waiting + len(ids) - i, since, flush + len(size), before)

    def _wait(self, waiting: int, since: int, flush: int, before: int | None) -> None:
        if before is not None and (not waiting or since != before):
            self.handle.deleteTimer(before + self.patience)
        if waiting and since != before:
            self.handle.registerTimer(since + self.patience)
        self.told.update((waiting, since, flush))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        waiting, since, flush = self.told.get()
        if waiting:
            ids, at = np.array([tuple(r) for r in self.rows.get()], np.int64).T
            yield self._taken(key, ["late"], [flush], [len(ids)], ids, at)
            self.rows.clear()
        self.told.update((0, since, flush + 1 if waiting else flush))


def coalesced(rows: DataFrame, target: int, patience_ms: int, most: int = 0, delay: str = "1 second") -> DataFrame:
    """A stream of (shard int, piece int, id long, ts timestamp) as flushes (FLUSHED)."""
    timed = rows.withWatermark("ts", delay).withColumn("at", F.unix_millis("ts"))
    return timed.groupBy("shard", "piece").transformWithStateInPandas(Buffer(target, patience_ms, most), FLUSHED, "Append", "EventTime")


def run(flushes: DataFrame, root: str) -> None:
    """Serves all input at hand into root/flushes/batch=N; a micro-batch that is tried again replaces its own folder."""
    spark = flushes.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/flushes/batch={number}")

    before = spark.conf.get(ROCKS[0])
    spark.conf.set(*ROCKS)
    try:
        job = flushes.writeStream.foreachBatch(put).option("checkpointLocation", f"{root}/state").start()
        try:
            job.processAllAvailable()
        finally:
            job.stop()
    finally:
        spark.conf.set(ROCKS[0], before)
