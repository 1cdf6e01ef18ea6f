"""Following runs from berth to berth, with a grace in which a run that is nowhere is not lost yet."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

# Fixed value: seconds after which a run that no berth reports is given up.
GRACE = 8
FOLLOWED = "descr string, td_area string, message string, berth string, at long, since long, n_berths long"


class _Follow(StatefulProcessor):
    """Per run: the berths that report it, where it is followed to, and since when no berth does."""

    def __init__(self, grace: int):
        self.grace = grace * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.berths = handle.getMapState("berths", "berth string", "n long")
        self.state = handle.getValueState("state", "target string, since long, gone long, n long")

    def _lost(self, key, since: int, gone: int, n: int) -> Row:
        return Row(descr=key[0], td_area=key[1], message="lost", berth=None, at=gone + self.grace, since=since, n_berths=n)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        target, since, gone, n = self.state.get() if self.state.exists() else (None, None, None, 0)
        now = {k[0]: v[0] for k, v in self.berths.iterator()}
        before = dict(now)
        for row in sorted(rows, key=lambda r: (r.at, r.half != "enter", r.number)):
            if gone is not None and row.at > gone + self.grace:
                yield self._lost(key, since, gone, n)
                target, since, gone, n = None, None, None, 0
            if row.half == "enter":
                now[row.berth] = now.get(row.berth, 0) + 1
                since, n, gone = row.at if since is None else since, n + 1, None
            elif row.berth in now:
                now[row.berth] -= 1
                if now[row.berth] <= 0:
                    del now[row.berth]
                gone = row.at if not now else None
            if now and target not in now:
                target = min(now)
                yield Row(descr=key[0], td_area=key[1], message="moved", berth=target, at=row.at, since=since, n_berths=n)
        for berth in before.keys() - now.keys():
            self.berths.removeKey((berth,))
        for berth, count in now.items():
            if before.get(berth) != count:
                self.berths.updateValue((berth,), (count,))
        self.state.update((target, since, gone, n))
        if gone is not None:
            self.handle.registerTimer(-(-(gone + self.grace) // 1000))

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        target, since, gone, n = self.state.get() if self.state.exists() else (None, None, None, 0)
        if gone is not None and -(-(gone + self.grace) // 1000) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
            yield self._lost(key, since, gone, n)

    def close(self) -> None:
        pass


def followed(sightings: DataFrame, grace: int = GRACE, delay: str = "0 seconds") -> DataFrame:
    """(descr, td_area, message, berth, at, since, n_berths): where each run is followed to, and when it is lost.

    ``sightings``: a stream of (descr, td_area, berth, seen_at, half, number), ``half`` being
    ``enter`` or ``leave``.  A run is followed to the first of the berths that report it, and
    stays there while that one does.  It is lost ``grace`` seconds after the last berth ceased
    to report it, unless one does again by then.
    """
    rows = sightings.withWatermark("seen_at", delay).select("descr", "td_area", "berth", "seen_at", F.unix_micros("seen_at").alias("at"), "half", "number")
    found = rows.groupBy("descr", "td_area").transformWithState(_Follow(grace), FOLLOWED, "Append", "EventTime")
    return found.withColumns({"at": F.timestamp_micros("at"), "since": F.timestamp_micros("since")})
