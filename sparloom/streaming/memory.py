"""The memory's write path as a stateful stream, one state a conversation."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.memory import STORED, Limits, Tiers, replay


def store_stream(turns: DataFrame, limits: Limits | None = None, idle_ms: int | None = None) -> DataFrame:
    """As operators.memory.store, for a stream of (conv_id, turn, role, text) in order of turns.

    The state holds the tiers and the last question, so an answer in a later
    micro-batch meets its question.  With idle_ms it goes after so long without turns
    (for streams that run on: timeouts keep a run over available input from ending).
    """
    limits = limits or Limits()

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tiers = pickle.loads(state.get[0]) if state.exists else Tiers()
        rows = pd.concat(list(frames))
        out = pd.DataFrame(replay(rows, tiers, limits), columns=[c.split()[0] for c in STORED.split(", ")])
        state.update((pickle.dumps(tiers),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield out

    return turns.select("conv_id", "turn", "role", "text").groupBy("conv_id").applyInPandasWithState(run, STORED, "tiers binary", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
