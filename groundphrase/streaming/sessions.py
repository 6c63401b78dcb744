"""Sessions as a stream: a counter that numbers each session's queries, and the trace of what was asked, kept in state
until the session has been silent for a while."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "session long, query_id string, text string, n_queries long, n_blank long, n_rows long, closed boolean"
NAMES = [c.split()[0] for c in OUT.split(", ")]


class Counter(StatefulProcessor):
    """Rows (session, ts, text) of a session in; a row for each query with its number, and one when the session closes."""

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "queries long, blank long, rows long")
        self.trace = handle.getMapState("trace", "query_id string", "text string")
        self.due = handle.getValueState("due", "ms long")

    def _closed(self, key) -> tuple:
        """The sums of what the state holds, which ends here."""
        queries, blank, n = self.counts.get()
        asked = ",".join(sorted(k[0] for k in self.trace.keys()))
        for state in (self.counts, self.trace, self.due):
            state.clear()
        return key[0], asked, None, queries, blank, n, True

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for part in rows:
            part = part.sort_values(["ts", "text"], kind="stable")
            for ts, text in zip(part["ts"], part["text"], strict=True):
                now, due = int(pd.Timestamp(ts).timestamp() * 1000), self.due.get()[0] if self.due.exists() else None
                if due is not None and now > due:  # silent for long enough, though the watermark has yet to say so
                    self.handle.deleteTimer(due)
                    out.append(self._closed(key))
                    due = None
                queries, blank, n = self.counts.get() if self.counts.exists() else (0, 0, 0)
                asks = bool((text or "").strip())
                queries, blank, n = queries + asks, blank + (not asks), n + 1
                if asks:
                    name = f"s{key[0]}-{queries:05d}"
                    self.trace.updateValue((name,), (text,))
                    out.append((key[0], name, text, queries, blank, n, False))
                self.counts.update((queries, blank, n))
                if due is None or now + self.silence_ms > due:
                    if due is not None:
                        self.handle.deleteTimer(due)
                    self.handle.registerTimer(now + self.silence_ms)
                    self.due.update((now + self.silence_ms,))
        yield pd.DataFrame(out, columns=NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.counts.exists():
            yield pd.DataFrame([self._closed(key)], columns=NAMES)

    def close(self) -> None:
        pass


def numbered(stream: DataFrame, session: str, ts: str, text: str, late: str = "10 minutes", silence_ms: int = 1_800_000) -> DataFrame:
    """OUT of a stream: each query with its number in its session as it comes, and the session's sums with the names of
    all its queries once the watermark has passed its last row by silence_ms. Rows of a batch are taken by time, then text."""
    s = stream.select(F.col(session).cast("long").alias("session"), F.col(ts).alias("ts"), F.col(text).alias("text")).withWatermark("ts", late)
    return s.groupBy("session").transformWithStateInPandas(statefulProcessor=Counter(silence_ms), outputStructType=OUT, outputMode="Update", timeMode="EventTime")
