"""Occupancies from a stream of touches.

Each berth keeps one open occupancy as state; a touch closes it and may open the next.
There is no watermark: arrival order counts and nothing is dropped, so state lasts as long
as its berth does.  The state store has to be RocksDB (``deltas.stateful``).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues

OUT = "td_area string, berth string, occupancy_id long, descr string, entered_at timestamp, left_at timestamp, exit_seq long, exit_reason string, anomaly string"


class _Berth(StatefulProcessor):
    """The occupancy that is open in a berth, if one is."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "seq long, descr string, entered_at timestamp")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        seq, descr, entered = self.open.get() if self.open.exists() else (None, None, None)
        for touch in sorted(rows, key=lambda r: r.seq):
            wrong = touch.checked and descr != touch.descr
            anomaly = ("from_berth_empty" if descr is None else "from_berth_description_mismatch") if wrong else None
            if seq is not None or wrong:
                reason = touch.reason if seq is not None else None
                yield Row(td_area=key[0], berth=key[1], occupancy_id=seq, descr=descr, entered_at=entered, left_at=touch.event_at, exit_seq=touch.seq, exit_reason=reason, anomaly=anomaly)
            seq, descr, entered = (touch.seq, touch.descr, touch.event_at) if touch.opens else (None, None, None)
        if seq is not None:
            self.open.update((seq, descr, entered))
        else:
            self.open.clear()

    def close(self) -> None:
        pass


def occupancy_stream(touches: DataFrame) -> DataFrame:
    """Ended occupancies, and anomalies where they show, as touches (a streaming table) arrive."""
    return touches.groupBy("td_area", "berth").transformWithState(_Berth(), OUT, "Append", "None")
