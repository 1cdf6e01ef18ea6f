"""Ingest statistics that also report windows in which nothing came, by timers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

STATS = "feed_name string, window_start long, n long, mean_ms double, max_lag_s double"


class _Windows(StatefulProcessor):
    """Per feed the windows not reported yet, and a timer at the end of the next one."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getMapState("windows", "start long", "n long, total double, lag double")
        self.next = handle.getValueState("next", "start long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        found: dict[int, tuple] = {}
        for row in rows:
            start = row.received // self.size * self.size
            n, total, lag = found.get(start, (0, 0.0, None))
            lag = row.lag if lag is None else lag if row.lag is None else max(lag, row.lag)
            found[start] = (n + 1, total + (row.processing_ms or 0.0), lag)
        for start, (n, total, lag) in found.items():
            if self.windows.containsKey((start,)):
                m, more, most = self.windows.getValue((start,))
                n, total, lag = n + m, total + more, most if lag is None else lag if most is None else max(lag, most)
            self.windows.updateValue((start,), (n, total, lag))
        held = self.next.get()[0] if self.next.exists() else None
        if found and (held is None or min(found) < held):
            if held is not None:
                self.handle.deleteTimer(held + self.size)
            self._wait_for(min(found))
        return iter(())

    def _wait_for(self, start: int) -> None:
        self.next.update((start,))
        self.handle.registerTimer(start + self.size)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        start, passed = self.next.get()[0], timerValues.getCurrentWatermarkInMs()
        while start + self.size <= passed:
            n, total, lag = 0, 0.0, None
            if self.windows.containsKey((start,)):
                n, total, lag = self.windows.getValue((start,))
                self.windows.removeKey((start,))
            yield Row(feed_name=key[0], window_start=start, n=n, mean_ms=total / n if n else None, max_lag_s=lag)
            start += self.size
        self._wait_for(start)

    def close(self) -> None:
        pass


def quiet_windows(frames: DataFrame, seconds: int = 30, delay: str = "0 seconds") -> DataFrame:
    """(feed_name, window_start, n, mean_ms, max_lag_s) of each tumbling window of receipt from a feed's first frame on.

    A stream of (feed_name, received_at, event_at, processing_ms).  A window is reported when
    the time of receipt of all feeds together has passed its end by ``delay``; one without
    frames has n = 0 and no further figures.  Timers are kept per feed, so a feed that falls
    silent goes on reporting as long as any other sends.
    """
    lag = (F.unix_millis("received_at") - F.unix_millis("event_at")) / 1000
    rows = frames.withWatermark("received_at", delay).select("feed_name", "received_at", F.unix_millis("received_at").alias("received"), lag.alias("lag"), F.col("processing_ms").cast("double").alias("processing_ms"))
    found = rows.groupBy("feed_name").transformWithState(_Windows(seconds * 1000), STATS, "Append", "EventTime")
    return found.withColumn("window_start", F.timestamp_millis("window_start"))
