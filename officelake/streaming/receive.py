"""Delivery of messages to agents as a stateful stream: the ids each agent has had by topic, and a timeout."""

from __future__ import annotations

from typing import Any, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DELIVERY = T.StructType(
    [
        T.StructField("agent", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("message", T.StringType()),
    ]
)


def unseen(ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which ids lie in none of the closed intervals, which are sorted and apart."""
    if not len(low):
        return np.ones(len(ids), bool)
    at = np.searchsorted(low, ids, "right") - 1
    return (at < 0) | (ids > high[np.maximum(at, 0)])


def with_ids(ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The intervals with some more ids in them; neighbouring ones become one."""
    low, high = np.concatenate([low, ids]), np.concatenate([high, ids])
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.append(True, low[1:] > high[:-1] + 1)
    return low[new], high[np.append(np.flatnonzero(new)[1:] - 1, len(high) - 1)]


class Receiver(StatefulProcessor):
    """Hands an agent each message once, however late it comes; after ``timeout_ms`` without one it says so.

    An agent that is registered, as a row of the initial state, has a timer from the first batch on, with or without
    a message. Ids more than ``late`` below a topic's highest one count as delivered, which bounds what is
    remembered of a topic; None remembers all.
    """

    def __init__(self, timeout_ms: int = 0, late: int | None = None):
        self.timeout_ms, self.late = timeout_ms, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        topic = T.StructType([T.StructField("topic", T.StringType())])
        ids = T.StructType([T.StructField("low", T.ArrayType(T.LongType())), T.StructField("high", T.ArrayType(T.LongType()))])
        self.had = handle.getMapState("had", topic, ids)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        self._wait(timerValues)

    def _wait(self, timerValues: Any) -> None:
        if self.timeout_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for batch in rows:  # a piece of the agent's messages at a time
            kept = []
            for topic, mine in batch.sort_values("id").drop_duplicates(["topic", "id"]).groupby("topic"):
                low, high = (np.array(x, np.int64) for x in (self.had.getValue((topic,)) if self.had.containsKey((topic,)) else ((), ())))
                ids = mine["id"].to_numpy(np.int64)
                fresh = unseen(ids, low, high)
                if self.late is not None and len(high):
                    fresh &= ids >= high[-1] - self.late
                if fresh.any():
                    low, high = with_ids(ids[fresh], low, high)
                    if self.late is not None:
                        old = low < high[-1] - self.late
                        if old.sum() > 1:
                            low, high = np.append(low[0], low[~old]), np.append(high[old].max(), high[~old])
                    self.had.updateValue((topic,), (low.tolist(), high.tolist()))
                    kept.append(mine[fresh])
            if kept:
                out = pd.concat(kept).sort_values("id")
                yield pd.DataFrame(
                    {"agent": key[0], "status": "message", "topic": out["topic"], "id": out["id"], "message": out["message"]}
                )
        self._wait(timerValues)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"agent": [key[0]], "status": ["timeout"], "topic": [None], "id": pd.array([None], "Int64"), "message": [None]})

    def close(self) -> None:
        pass


def deliveries(
    messages: DataFrame, subscriptions: DataFrame, timeout_ms: int = 0, registered: DataFrame | None = None, late: int | None = None
) -> DataFrame:
    """Messages of a stream delivered to the agents subscribed to their topic.

    Every delivery is a row, so this is for topics with few listeners, such as inboxes. For topics that many
    agents listen to, ``bus.receive`` looks up the one next message of each agent and fans nothing out. ``registered``
    (agent) are agents that wait from the stream's start on; without a timeout they make no difference.
    """
    routed = messages.join(subscriptions, "topic").select("agent", "topic", "id", "message")
    known = {"initialState": registered.select("agent").distinct().groupBy("agent")} if registered is not None and timeout_ms else {}
    return routed.groupBy("agent").transformWithStateInPandas(
        statefulProcessor=Receiver(timeout_ms, late),
        outputStructType=DELIVERY,
        outputMode="append",
        timeMode="ProcessingTime" if timeout_ms else "None",
        **known,
    )
