"""Search sessions as streaming state: events in, the session as it stands out.

A session keeps its questions and, for each text, the last label, both by event time and event id, so
events that come late (within the watermark) or again change nothing that they should not: the state
depends on which events came, not on their order.  Labels count from when the present question was
first asked without another in between.  A session that has been quiet for idle ends: a last row
says so and its state goes.  A batch reads a session's state once and writes it once, however many events it has."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Events: kind is ask (text is the question), pos, neg or none (text is the labelled id).
EVENTS = "session_id string, event_id long, ts timestamp, kind string, text string"
SESSIONS = "session_id string, query string, positive_ids array<string>, negative_ids array<string>, n_events long, ended boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def standing(asked: list[tuple[int, int, str]], labels: dict[str, tuple[int, int, str]]) -> tuple[str | None, list[str], list[str]]:
    """The present question and its positive and negative ids.  asked: (time, event, question); labels: by id."""
    since, query = (-(1 << 62), 0), None
    for at, event, text in sorted(asked):
        if text != query:
            since, query = (at, event), text
    now = sorted((i, kind) for i, (at, event, kind) in labels.items() if (at, event) > since)
    return query, [i for i, k in now if k == "pos"], [i for i, k in now if k == "neg"]


class Sessions(StatefulProcessor):
    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.asked = handle.getListState("asked", "at long, event long, question string")
        self.labels = handle.getListState("labels", "id string, at long, event long, kind string")
        self.last = handle.getValueState("last", "at long, n long")

    def _read(self) -> tuple[dict[tuple[int, int], str], dict[str, tuple[int, int, str]]]:
        """A session's questions and labels, in one request each."""
        return {(r[0], r[1]): r[2] for r in self.asked.get()}, {r[0]: (r[1], r[2], r[3]) for r in self.labels.get()}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.last.exists()
        before, n = self.last.get() if known else (-(1 << 62), 0)
        asked, labels = self._read() if known else ({}, {})
        last, more_asked, more_labels = before, False, False
        for frame in rows:
            for event, ts, kind, text in zip(frame.event_id, frame.ts, frame.kind, frame.text):
                event, at = int(event), int(ts.value // 1000)
                if kind == "ask":
                    n += (at, event) not in asked
                    asked[at, event], more_asked = text, True
                elif text not in labels or (at, event) > labels[text][:2]:
                    n += 1
                    labels[text], more_labels = (at, event, kind), True
                last = max(last, at)
        if more_asked:
            self.asked.put([(*k, question) for k, question in asked.items()])
        if more_labels:
            self.labels.put([(i, *label) for i, label in labels.items()])
        due = lambda at: at // 1000 + self.idle_ms
        if not known or due(last) != due(before):
            if known:
                self.handle.deleteTimer(due(before))
            self.handle.registerTimer(due(last))
        self.last.update((last, n))
        yield self._row(key, asked, labels, n, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        row = self._row(key, *self._read(), self.last.get()[1], True)
        for state in (self.asked, self.labels, self.last):
            state.clear()
        yield row

    def _row(self, key, asked: dict, labels: dict, n: int, ended: bool) -> pd.DataFrame:
        query, positive, negative = standing([(*k, question) for k, question in asked.items()], labels)
        return pd.DataFrame({"session_id": [key[0]], "query": [query], "positive_ids": [positive], "negative_ids": [negative], "n_events": [n], "ended": [ended]})

    def close(self) -> None:
        pass


def session_states(events: DataFrame, late: str = "10 minutes", idle: dt.timedelta = dt.timedelta(hours=1)) -> DataFrame:
    """A row for each session that a batch touches or ends: for update output, with the RocksDB state store."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return events.withWatermark("ts", late).groupBy("session_id").transformWithStateInPandas(Sessions(int(idle.total_seconds() * 1000)), SESSIONS, "Update", "EventTime")
