"""Keyed state over streams: rolling budgets, replay checks, sticky assignments.

State per key is a few numbers. Groups arrive as iterators of Arrow batches; a
micro-batch's rows of a key are put in order as columns of numbers (16 bytes a
row), and the files of a micro-batch are bounded (`replay.FILES_PER_BATCH`).
Rows without a time or number are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _ordered(batches: Iterator[pd.DataFrame], *columns: str) -> Iterator[tuple]:
    """The rows of a key's batches in the order of their columns."""
    rows = pd.concat([b[list(columns)] for b in batches]).dropna()
    rows = rows.sort_values(list(columns), kind="stable")
    return zip(*(rows[c].to_numpy() for c in columns))


def rolling_budget(stream: DataFrame, window_seconds: int) -> DataFrame:
    """user_id, anchor (microseconds), total after each batch: amounts within the window of the anchor add up, a later one begins anew.

    stream: user_id, at (microseconds), cost. Late rows within a batch are put
    in order; a row of a later batch that is older than the anchor counts to it.
    """
    span = window_seconds * 1_000_000

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        anchor, total = state.get if state.exists else (None, 0)
        for at, cost in _ordered(batches, "at", "cost"):
            at, cost = int(at), int(cost)
            if anchor is None or at - anchor >= span:
                anchor, total = at, cost
            else:
                total += cost
        if anchor is None:
            return
        state.update((anchor, total))
        yield pd.DataFrame({"user_id": [key[0]], "anchor": [anchor], "total": [total]})

    return stream.groupBy("user_id").applyInPandasWithState(fold, "user_id long, anchor long, total long", "anchor long, total long", "update", GroupStateTimeout.NoTimeout)


def replay_check(stream: DataFrame) -> DataFrame:
    """aggregate_id, latest, applied, ignored, gaps after each batch: rows up to the latest number are ignored, the next is applied, others are gaps.

    stream: aggregate_id, seq, received (microseconds). A gap doesn't move the latest number.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        latest, applied, ignored, gaps = state.get if state.exists else (-1, 0, 0, 0)
        for _, seq in _ordered(batches, "received", "seq"):
            seq = int(seq)
            if seq <= latest:
                ignored += 1
            elif seq == latest + 1:
                latest, applied = seq, applied + 1
            else:
                gaps += 1
        state.update((latest, applied, ignored, gaps))
        yield pd.DataFrame({"aggregate_id": [key[0]], "latest": [latest], "applied": [applied], "ignored": [ignored], "gaps": [gaps]})

    return stream.groupBy("aggregate_id").applyInPandasWithState(fold, "aggregate_id string, latest long, applied long, ignored long, gaps long", "latest long, applied long, ignored long, gaps long", "update", GroupStateTimeout.NoTimeout)


def sticky(stream: DataFrame, ttl_seconds: int) -> DataFrame:
    """user_id, choice, until: the first choice of a user, kept for the time to live after its last use.

    stream: user_id, at (microseconds), choice.
    """
    span = ttl_seconds * 1_000_000

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        choice, until = state.get if state.exists else ("", -1)
        for at, offered in _ordered(batches, "at", "choice"):
            if at >= until:
                choice = str(offered)
            until = int(at) + span
        state.update((choice, until))
        yield pd.DataFrame({"user_id": [key[0]], "choice": [choice], "until": [until]})

    return stream.groupBy("user_id").applyInPandasWithState(fold, "user_id long, choice string, until long", "choice string, until long", "update", GroupStateTimeout.NoTimeout)
