"""Deltas of maps from polled states, and clients that take a snapshot and the deltas after it, as streams.

State is kept per map: a map state with a row per element, and the last sequence.  Rows of a
micro-batch may come in any order; from batch to batch polls (or sequences) do not go back.
Output then is the same however the rows are split into batches, and the same as that of
the batch operators in ``live``.  The snapshot goes in as initial state, so what it holds is
never sent again, and nothing after it is missed.

The state store has to be RocksDB (``stateful`` sets it for a session).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues

DELTAS = "slug string, element_id string, message string, descr string, sequence long"
APPLIED = "slug string, element_id string, descr string, sequence long, action string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB, in no more partitions than two per core."""
    partitions = "spark.sql.shuffle.partitions"
    most = min(int(spark.conf.get(partitions)), 2 * spark.sparkContext.defaultParallelism)
    before = {key: spark.conf.get(key, None) for key in (PROVIDER, partitions)}
    spark.conf.set(PROVIDER, ROCKSDB)
    spark.conf.set(partitions, str(most))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value else spark.conf.unset(key)


class _Held:
    """A map state that is read at most once per key and batch, and written once."""

    def __init__(self, state):
        self.state, self.seen, self.changed = state, {}, set()

    def get(self, key):
        if key not in self.seen:
            self.seen[key] = tuple(self.state.getValue((key,))) if self.state.containsKey((key,)) else None
        return self.seen[key]

    def put(self, key, value: tuple | None) -> None:
        self.seen[key] = value
        self.changed.add(key)

    def store(self) -> None:
        for key in self.changed:
            if self.seen[key] is not None:
                self.state.updateValue((key,), self.seen[key])
            elif self.state.containsKey((key,)):
                self.state.removeKey((key,))


class _Polled(StatefulProcessor):
    """What changed since the last poll of each element, with one rising sequence per map."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.elements = handle.getMapState("elements", "element_id string", "descr string, entered long")
        self.last = handle.getValueState("last", "sequence long")

    def _taken(self) -> int:
        return self.last.get()[0] if self.last.exists() else 0

    def handleInitialState(self, key, initialState: Row, timerValues: TimerValues) -> None:
        self.elements.updateValue((initialState.element_id,), (initialState.descr, initialState.entered))
        self.last.update((max(self._taken(), initialState.sequence or 0),))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        taken, held = self._taken(), _Held(self.elements)
        for row in sorted(rows, key=lambda r: (r.poll, r.element_id)):
            now = (row.descr, row.entered)
            if held.get(row.element_id) == now:
                continue
            held.put(row.element_id, now)
            taken = max(taken + 1, row.sequence or 0)
            yield Row(slug=key[0], element_id=row.element_id, message="berth.cleared" if row.descr is None else "berth.updated", descr=row.descr, sequence=taken)
        held.store()
        self.last.update((taken,))

    def close(self) -> None:
        pass


def _state(rows: DataFrame) -> DataFrame:
    return rows.withColumn("entered", F.unix_micros(F.col("entered_at").cast("timestamp"))).drop("entered_at")


def polled_deltas(polls: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """(slug, element_id, message, descr, sequence) from a stream of (slug, element_id, descr, entered_at, sequence, poll).

    ``snapshot``: (slug, element_id, descr, entered_at, sequence) before the first poll.  An
    element changes with its description or the time of entry, or when it is first seen.  The
    changes of a map, by poll and element, get what was observed as their sequence, or one
    more than the one before if that is not higher.
    """
    first = None if snapshot is None else _state(snapshot.select("slug", "element_id", "descr", "entered_at", "sequence")).groupBy("slug")
    return _state(polls).groupBy("slug").transformWithState(_Polled(), DELTAS, "Append", "None", first)


class _Client(StatefulProcessor):
    """A client's view of a map: its snapshot with the deltas beyond it applied."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.elements = handle.getMapState("elements", "element_id string", "descr string, sequence long")
        self.last = handle.getValueState("last", "sequence long")

    def handleInitialState(self, key, initialState: Row, timerValues: TimerValues) -> None:
        self.elements.updateValue((initialState.element_id,), (initialState.descr, initialState.sequence))
        self.last.update((max(self.last.get()[0] if self.last.exists() else -1, initialState.sequence),))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        sent = self.last.get()[0] if self.last.exists() else -1
        held = _Held(self.elements)
        for row in sorted(rows, key=lambda r: r.sequence):
            if row.sequence <= sent:  # the snapshot, or what was sent, has it already
                continue
            sent = row.sequence
            if held.get(row.element_id) is None:
                continue
            held.put(row.element_id, (row.descr, row.sequence))
            yield Row(slug=key[0], element_id=row.element_id, descr=row.descr, sequence=row.sequence, action="apply")
        held.store()
        self.last.update((sent,))

    def close(self) -> None:
        pass


def client_stream(deltas: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(slug, element_id, descr, sequence, action): what a client with the snapshot applies of a stream of (slug, element_id, descr, sequence).

    Deltas that the snapshot reflects and elements that it does not have are left out.
    """
    first = snapshot.select("slug", "element_id", "descr", "sequence").groupBy("slug")
    return deltas.select("slug", "element_id", "descr", "sequence").groupBy("slug").transformWithState(_Client(), APPLIED, "Append", "None", first)
