"""The resolver as a stream: new occupancies at once, open ones that are not matched again by timer."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from trackledger.operators.resolver import CONTINUITY_MINUTES, RETRY_MINUTES, decided, supported

DECISIONS = "occupancy_id long, status string, run_id string, score int, phase string, decided_ms long"
_MINUTE = 60_000_000
#: Occupancy numbers of a page of state.
PAGE = 4096


class _Resolver(StatefulProcessor):
    """Per (description, area): the newest match, and the open occupancies without one.

    Each access to state is a message to the JVM, so what a call needs is read once and written
    once: open occupancies lie in pages of neighbouring numbers, and one timer stands for all.
    """

    def __init__(self, retry_minutes: int):
        self.retry_ms = retry_minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.match = handle.getValueState("match", "run_id string, at long")
        self.facts = handle.getValueState("facts", "facts string")
        self.due = handle.getValueState("due", "at long")
        self.open = handle.getMapState("open", "page long", "occupancies string")

    def _begin(self) -> None:
        """Reads what every decision of this call needs."""
        self.found = tuple(self.match.get()) if self.match.exists() else None
        self.run = self.facts.get()[0] if self.facts.exists() else None
        self.before = self.found, self.run
        self.run_of = json.loads(self.run) if self.run else None
        self.pages, self.changed = {}, set()
        self.timer = self.due.get()[0] if self.due.exists() else None
        self.soonest = self.timer

    def _end(self) -> None:
        """Writes what this call has changed."""
        if self.found != self.before[0]:
            self.match.update(self.found)
        if self.run != self.before[1]:
            self.facts.update((self.run,))
        for number in self.changed:
            if self.pages[number]:
                self.open.updateValue((number,), (json.dumps([[k, *v] for k, v in self.pages[number].items()]),))
            elif self.open.containsKey((number,)):
                self.open.removeKey((number,))
        if self.soonest != self.timer:
            if self.timer is not None:
                self.handle.deleteTimer(self.timer)
            if self.soonest is None:
                self.due.clear()
            else:
                self.handle.registerTimer(self.soonest)
                self.due.update((self.soonest,))

    def _page(self, occupancy: int) -> dict[int, tuple]:
        """The open occupancies, as (at, candidates, decided), of the page that one is on."""
        number = occupancy // PAGE
        if number not in self.pages:
            held = self.open.getValue((number,)) if self.open.containsKey((number,)) else None
            self.pages[number] = {k: tuple(v) for k, *v in json.loads(held[0])} if held else {}
        return self.pages[number]

    def _keep(self, occupancy: int, value: tuple | None) -> None:
        page = self._page(occupancy)
        if value is not None:
            page[occupancy] = value
        elif page.pop(occupancy, None) is None:
            return
        self.changed.add(occupancy // PAGE)

    def _decide(self, at: int, candidates: str) -> tuple[str, str | None, int]:
        match, offered = self.found, json.loads(candidates)
        if isinstance(offered, list):
            found = decided(offered, at, match, CONTINUITY_MINUTES * _MINUTE)
        else:
            found = self._supported(at, offered, match)
        if found[1] is not None and (match is None or at > match[1]):
            self.found = (found[1], at)
            if isinstance(offered, dict) and found[1] == offered["run_id"]:
                self.run, self.run_of = candidates, offered
        return found

    def _supported(self, at: int, best: dict, match: tuple | None) -> tuple[str, str | None, int]:
        run = self.run_of if match else None
        if run is not None and run["run_id"] == match[0] and run["service_date"] == best["service_date"]:
            match = (*match, run["began"], run["linked"], run["cells"] or [])
        else:
            match = None  # no candidate on this date
        return supported(best["score"], best["n"], best["run_id"], best["berth"], at, best["newest"], match, CONTINUITY_MINUTES * _MINUTE)

    def _put(self, occupancy: int, at: int, candidates: str, now: int, phase: str) -> Row:
        status, run, score = self._decide(at, candidates)
        if status != "matched":
            self._keep(occupancy, (at, candidates, now))
            self.soonest = min(now + self.retry_ms, now + self.retry_ms if self.soonest is None else self.soonest)
        else:
            self._keep(occupancy, None)
        return Row(occupancy_id=occupancy, status=status, run_id=run, score=score, phase=phase, decided_ms=now)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        self._begin()
        reached = timerValues.getCurrentWatermarkInMs()
        out = []
        for row in sorted(rows, key=lambda r: (r.at, r.occupancy_id)):
            if row.kind == "enter":
                out.append(self._put(row.occupancy_id, row.at, row.candidates, max(row.at // 1000, reached), "new"))
                continue
            held = self._page(row.occupancy_id).get(row.occupancy_id)
            if held is not None:
                self._keep(row.occupancy_id, None if row.kind == "leave" else (held[0], row.candidates, held[2]))
        self._end()
        yield from out

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self._begin()
        now = timerValues.getCurrentWatermarkInMs()
        if self.timer is None or self.timer > now:
            return  # answered already: one pass over what is open, not one per timer
        self.pages = {number: {k: tuple(v) for k, *v in json.loads(held)} for (number,), (held,) in self.open.iterator()}
        due = sorted((when, at, occupancy, candidates) for page in self.pages.values() for occupancy, (at, candidates, when) in page.items() if when + self.retry_ms <= now)
        out = [self._put(occupancy, at, candidates, now, "retry") for _, at, occupancy, candidates in due]
        self.timer = None  # it has gone off
        left = [when for page in self.pages.values() for _, _, when in page.values()]
        self.soonest = min(left) + self.retry_ms if left else None
        if self.soonest is None:
            self.due.clear()
        self._end()
        yield from out

    def close(self) -> None:
        pass


def resolution_stream(events: DataFrame, retry_minutes: int = RETRY_MINUTES, delay: str = "0 seconds") -> DataFrame:
    """(occupancy_id, status, run_id, score, phase, decided_at) as occupancies enter, and again while they stay open without a match.

    ``events``: a stream of (descr, td_area, occupancy_id, happened_at, kind, candidates), the
    candidates as an array of (run_id, activated_at, score).  ``enter`` brings an occupancy and
    its candidates, ``offer`` other candidates for one that is open, ``leave`` ends it.  Both
    phases decide with continuity from the newest match of the key.  Keys are independent, and
    their state is one match and the open occupancies without one.  Instead of candidates an
    event may have ``best``, a struct (score, n, run_id, service_date, berth, newest, began,
    linked, cells) of ``tops`` and ``with_facts``: its size does not grow with the runs.
    """
    one = lambda c: F.struct(c["run_id"].alias("run_id"), F.unix_micros(c["activated_at"].cast("timestamp")).alias("activated_at"), c["score"].alias("score"))
    if "best" in events.columns:
        offered = F.col("best")
    else:
        offered = F.array_sort(F.transform(F.coalesce("candidates", F.array().cast(events.schema["candidates"].dataType)), one))
    rows = events.withWatermark("happened_at", delay).select(
        "descr", "td_area", "occupancy_id", "happened_at", F.unix_micros("happened_at").alias("at"), "kind",
        F.to_json(offered, {"ignoreNullFields": "false"}).alias("candidates"),
    )
    found = rows.groupBy("descr", "td_area").transformWithState(_Resolver(retry_minutes), DECISIONS, "Append", "EventTime")
    return found.withColumn("decided_at", F.timestamp_millis("decided_ms")).drop("decided_ms")
