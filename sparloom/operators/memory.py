"""Three-tier conversation memory: recent turns, gated long-term and episodic entries.

Set-based reads are window queries.  The write path is sequential by nature (an
entry is compared with the entries accepted before it); one pure function,
fold(), serves the batch form (one group a session) and the streaming form.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass
class Limits:
    short: int = 20
    long: int = 1000
    episodes: int = 200
    long_gate: float = 0.4
    episode_gate: float = 0.5
    duplicate: float = 0.99


@dataclass
class Tiers:
    """State of a session: turns, (vector, text) entries, and the last question's vector."""

    short: list = field(default_factory=list)
    long: list = field(default_factory=list)
    episodes: list = field(default_factory=list)
    asked: np.ndarray | None = None


def recent(turns: DataFrame, session: str, order: str, k: int) -> DataFrame:
    """The last k turns of each session, rank 1 the newest."""
    newest = Window.partitionBy(session).orderBy(F.desc(order))
    return turns.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= k)


def buffers(turns: DataFrame, session: str, order: str, size: int) -> DataFrame:
    """Adds buffer: the turns held after each turn."""
    frame = Window.partitionBy(session).orderBy(order).rowsBetween(1 - size, Window.currentRow)
    return turns.withColumn("buffer", F.collect_list(order).over(frame))


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    both = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / both) if both > 1e-9 else 0.0


def gate(entries: list, vector: np.ndarray, asked: np.ndarray | None, text: str, least: float, duplicate: float, cap: int) -> bool:
    """Accepts an entry close enough to the question, if there is one, and unlike all entries so far; the oldest goes at the cap."""
    if asked is not None and _cosine(vector, asked) < least or any(_cosine(vector, e[0]) >= duplicate for e in entries):
        return False
    entries.append((vector, text))
    del entries[: max(0, len(entries) - cap)]
    return True


def fold(state: Tiers, turn: tuple, limits: Limits) -> tuple[int, int, int, bool, bool]:
    """One turn (order, role, text, question vector, candidate vector): sizes of the tiers, and what was accepted."""
    order, role, text, asked, candidate = turn
    state.short.append((order, role, text))
    del state.short[: max(0, len(state.short) - limits.short)]
    kept = role == "assistant" and gate(state.long, candidate, asked, text, limits.long_gate, limits.duplicate, limits.long)
    episode = role == "assistant" and gate(state.episodes, candidate, asked, text[:256], limits.episode_gate, limits.duplicate, limits.episodes)
    return len(state.short), len(state.long), len(state.episodes), kept, episode


def embed(text: str, dim: int = 384) -> np.ndarray:
    """The hashing embedding of functions.vectors, for use inside a session's fold; a worker keeps slots of tokens it has met."""
    import re

    from .retrieval import _slot

    out = np.zeros(dim)
    for tok in re.findall("[a-z0-9_]+", (text or "").lower()):
        slot, sign = _slot(tok, dim)
        out[slot] += sign
    n = np.linalg.norm(out)
    return out / n if n else out


STORED = "conv_id long, turn long, stm int, ltm int, em int, ltm_accepted boolean, em_accepted boolean"


def replay(rows: pd.DataFrame, state: Tiers, limits: Limits) -> Iterator[tuple]:
    """A session's turns in order: an assistant turn is weighed against the user turn before it."""
    for conv, turn, role, text in rows.sort_values("turn")[["conv_id", "turn", "role", "text"]].itertuples(index=False):
        vector = embed(text)
        if role == "user":
            state.asked = vector
        yield conv, turn, *fold(state, (turn, role, text or "", state.asked, vector), limits)


def store(turns: DataFrame, limits: Limits | None = None) -> DataFrame:
    """The tiers' sizes after every turn (conv_id, turn, role, text)."""
    limits = limits or Limits()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(replay(rows, Tiers(), limits), columns=[c.split()[0] for c in STORED.split(", ")])

    return turns.select("conv_id", "turn", "role", "text").groupBy("conv_id").applyInPandas(run, STORED)
