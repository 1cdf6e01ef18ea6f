"""Streams with state and timers: any split into batches gives the rows of the batch operators."""

import json
import random
import time
import types
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from trackledger.operators import berths, intervals, resolver
from trackledger.streaming import deltas, live, quiet, resolution

T0 = datetime(2026, 1, 1, 12)


def run(spark, tmp_path, rows, schema, pieces, transform):
    """The stream's rows, in the order of its batches, with the rows cut into so many batches."""
    cuts = [round(k * len(rows) / pieces) for k in range(pieces + 1)]
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        own = rows[a:b]
        random.Random(k).shuffle(own)
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = []
    with deltas.stateful(spark):
        sink = transform(source).writeStream.foreachBatch(lambda batch, n: found.extend(map(tuple, batch.collect())))
        sink.outputMode("append").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return found


def polls(seed):
    rng, rows = random.Random(seed), []
    now = {f"e{k}": (None, None) for k in range(5)}
    first = [("m", e, None, None, 3) for e in now]
    for poll in range(1, 30):
        for e in sorted({*now, "late"} if poll > 10 else now):
            if rng.random() < 0.4:
                filled = rng.random() < 0.6
                now[e] = (rng.choice("AB"), T0 + timedelta(minutes=rng.randint(0, 2))) if filled else (None, None)
            state = now.get(e, (None, None))
            rows.append(("m", e, *state, rng.choice([poll, poll * 3, None]), poll))
    return first, rows


def polled_by_force(first, rows):
    held, taken, out = {e: (d, t) for _, e, d, t, _ in first}, max(r[4] for r in first), []
    for slug, e, d, t, seen, _ in rows:
        if e in held and held[e] == (d, t):
            continue
        held[e], taken = (d, t), max(taken + 1, seen or 0)
        out.append((slug, e, "berth.cleared" if d is None else "berth.updated", d, taken))
    return out


POLLED = "slug string, element_id string, descr string, entered_at timestamp, sequence long, poll int"


@pytest.mark.parametrize("pieces", [1, 4])
def test_polled_deltas_for_any_split(spark, tmp_path, pieces):
    first, rows = polls(3)
    snapshot = spark.createDataFrame(first, POLLED.rsplit(",", 1)[0])
    got = run(spark, tmp_path, rows, POLLED, pieces, lambda s: deltas.polled_deltas(s, snapshot))
    assert sorted(got, key=lambda r: r[4]) == polled_by_force(first, rows)


@pytest.mark.parametrize("pieces", [1, 3])
def test_a_client_misses_nothing_after_its_snapshot(spark, tmp_path, pieces):
    rng = random.Random(9)
    kind = "slug string, element_id string, descr string, sequence long"
    rows = [(rng.choice("mn"), f"e{rng.randint(0, 6)}", rng.choice(["A", "B", None]), k) for k in range(60)]
    snapshot = spark.createDataFrame([(m, f"e{k}", None, 20) for m in "mn" for k in range(5)], kind)
    got = run(spark, tmp_path, rows, kind, pieces, lambda s: deltas.client_stream(s, snapshot))
    assert got and all(r[3] > 20 and r[1] < "e5" for r in got)
    last = {(m, f"e{k}"): (None, 20) for m in "mn" for k in range(5)}
    last |= {(r[0], r[1]): (r[2], r[3]) for r in sorted(got, key=lambda r: r[3])}
    batch = live.folded(snapshot, spark.createDataFrame(rows, kind)).collect()
    assert last == {(r.slug, r.element_id): (r.descr, r.sequence) for r in batch}


@pytest.mark.parametrize("pieces", [1, 5])
def test_quiet_windows_are_reported(spark, tmp_path, pieces):
    at = [("a", 1), ("b", 2), ("a", 20), ("b", 31), ("b", 95), ("b", 400), ("a", 1900), ("b", 1901), ("b", 1990)]
    rows = [(f, T0 + timedelta(seconds=s), T0 + timedelta(seconds=s - 4), float(s)) for f, s in at]
    got = run(spark, tmp_path, rows, "feed_name string, received_at timestamp, event_at timestamp, processing_ms double", pieces, quiet.quiet_windows)
    want = []
    for feed in "ab":
        for k in range(1990 // 30):
            own = [s for f, s in at if f == feed and k * 30 <= s < (k + 1) * 30]
            want.append((feed, T0 + timedelta(seconds=30 * k), len(own), sum(own) / len(own) if own else None, 4.0 if own else None))
    assert sorted(got) == want
    assert sum(r[2] == 0 for r in got if r[0] == "a") > 60  # half an hour of silence


# The resolver

CANDIDATES = "array<struct<run_id:string,activated_at:timestamp,score:int>>"


def history(seed, n=150):
    rng, rows, at = random.Random(seed), [], T0
    for k in range(n):
        at += timedelta(minutes=rng.choice([0, 1, 4, 9, 10, 11, 40]))
        cands = [(f"r{j}", rng.choice([None, T0 - timedelta(minutes=j)]), rng.choice([0, 40, 40, 65])) for j in rng.sample(range(4), rng.randint(0, 3))]
        rows.append((k, "Z", rng.choice(["1A01", "2B02"]), at, sorted(cands)))
    return rows


def in_order(rows, fixed=()):
    match, out = {}, {}
    for k, area, descr, at, cands in sorted(rows, key=lambda r: (r[3], r[0])):
        key = (descr, area)
        if k in dict(fixed):
            if dict(fixed)[k]:
                match[key] = (dict(fixed)[k], at)
            continue
        own = [{"run_id": r, "activated_at": a, "score": s} for r, a, s in cands]
        out[k] = resolver.decided(own, at, match.get(key), timedelta(minutes=10))
        if out[k][1]:
            match[key] = (out[k][1], at)
    return out


def scored(spark, rows):
    flat = [(k, area, "1", descr, at, *c) for k, area, descr, at, cands in rows for c in cands]
    return spark.createDataFrame(flat, "occupancy_id long, td_area string, berth string, descr string, entered_at timestamp, run_id string, activated_at timestamp, score int")


def test_pieces_are_decided_as_the_whole_history(spark):
    for seed in (1, 2):
        rows = history(seed)
        got = {r.occupancy_id: (r.status, r.run_id, r.score) for r in resolver.decide_in_order(scored(spark, rows)).collect()}
        assert got == {k: v for k, v in in_order([r for r in rows if r[4]]).items()}


def test_a_run_of_the_resolver_goes_on_from_what_was_decided(spark):
    rows = history(5)
    first = in_order(rows)
    early = {r[0] for r in rows[:90]}
    occupied = spark.createDataFrame([(k, area, descr, at, None if k % 3 else 1) for k, area, descr, at, _ in rows], "occupancy_id long, td_area string, descr string, entered_at timestamp, exit_seq long")
    decisions = spark.createDataFrame([(k, *first[k], 0.0, 0, T0) for k in sorted(early)], "occupancy_id long, status string, run_id string, score int, confidence double, n_candidates long, decided_at timestamp")
    now = F.lit(T0 + timedelta(days=9)).cast("timestamp")
    due = resolver.due(occupied, decisions, now)
    after = resolver.resolve_due(decisions, due, scored(spark, rows), now, known=occupied.drop("exit_seq"))
    again = {r.occupancy_id for r in due.collect()}
    assert again == {k for k in range(len(rows)) if k not in early or (k % 3 and first[k][0] != "matched")}
    want = in_order(rows, [(k, first[k][1]) for k in early - again]) | {k: first[k] for k in early - again}
    assert {r.occupancy_id: (r.status, r.run_id, r.score) for r in after.collect()} == want


@pytest.mark.parametrize("pieces", [1, 4])
def test_resolver_stream_decides_in_order(spark, tmp_path, pieces):
    rows = history(7)
    events = [(descr, area, k, at, "enter", cands) for k, area, descr, at, cands in rows]
    got = run(spark, tmp_path, events, f"descr string, td_area string, occupancy_id long, happened_at timestamp, kind string, candidates {CANDIDATES}", pieces, resolution.resolution_stream)
    assert {r[0]: r[1:4] for r in got if r[4] == "new"} == in_order(rows)


def test_open_occupancies_are_retried_until_matched_or_left(spark, tmp_path):
    two = [("r1", T0, 40), ("r2", T0, 40)]
    minute = lambda n: T0 + timedelta(minutes=n)
    events = [
        ("1A01", "Z", 1, minute(0), "enter", two), ("1A01", "Z", 2, minute(1), "enter", two), ("9Z99", "Z", 9, minute(2), "enter", []),
        ("1A01", "Z", 1, minute(3), "offer", [("r1", T0, 75), ("r2", T0, 40)]), ("1A01", "Z", 2, minute(4), "leave", None), ("9Z99", "Z", 8, minute(30), "enter", []),
    ]
    got = run(spark, tmp_path, events, f"descr string, td_area string, occupancy_id long, happened_at timestamp, kind string, candidates {CANDIDATES}", 6, resolution.resolution_stream)
    assert [r[:2] for r in got if r[4] == "new"] == [(1, "ambiguous"), (2, "ambiguous"), (9, "unmatched"), (8, "unmatched")]
    retried = [r for r in got if r[4] == "retry"]
    assert [r[:4] for r in retried if r[0] == 1] == [(1, "matched", "r1", 75)] and not [r for r in retried if r[0] == 2] and [r for r in retried if r[0] == 9]


class Store:
    """State of one key, counting accesses."""

    def __init__(self):
        self.values, self.timers, self.n = {}, set(), 0

    def getValueState(self, name, schema):
        return Cell(self, name)

    def getMapState(self, name, key, value):
        return Cells(self)

    def registerTimer(self, at):
        self.n += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.n += 1
        self.timers.remove(at)


class Cell:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def __getattr__(self, what):
        self.store.n += 1
        held = self.store.values
        return {"exists": lambda: self.name in held, "get": lambda: held[self.name], "update": lambda v: held.__setitem__(self.name, v), "clear": lambda: held.pop(self.name, None)}[what]


class Cells:
    def __init__(self, store):
        self.store, self.held = store, {}

    def __getattr__(self, what):
        self.store.n += 1
        held = self.held
        return {"containsKey": held.__contains__, "getValue": held.__getitem__, "updateValue": held.__setitem__, "removeKey": held.__delitem__, "iterator": lambda: iter(list(held.items()))}[what]


def test_state_of_the_resolver_is_accessed_per_batch_not_per_occupancy():
    now = types.SimpleNamespace(getCurrentWatermarkInMs=lambda: now.at, at=0)
    none = json.dumps([])
    for n in (10, 1000):
        store, resolver_ = Store(), resolution._Resolver(5)
        resolver_.init(store)
        now.at = 0
        rows = [Row(occupancy_id=k, at=k * 1_000_000, kind="enter", candidates=none) for k in range(n)]
        assert [r.phase for r in resolver_.handleInputRows(("1A", "Z"), iter(rows), now)] == ["new"] * n
        assert store.timers == {300_000}
        now.at, store.timers = 9_000_000, set()
        assert [(r.occupancy_id, r.phase) for r in resolver_.handleExpiredTimer(("1A", "Z"), now, None)] == [(k, "retry") for k in range(n)]
        assert store.timers == {9_300_000} and store.n < 40


# Histories in segments


def test_pieces_and_neighbours_equal_plain_loops(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice("ab"), T0 + timedelta(minutes=rng.choice([k // 3, k // 3 * 20, k * 7])), rng.choice([None, k])) for k in range(300)]
    frame = spark.createDataFrame(rows, "seq long, key string, at timestamp, v long")
    got = {r.seq: (r.key, r.piece) for r in intervals.with_pieces(frame, ["key"], "at", 600).collect()}
    for key in "ab":
        number, last = 0, None
        for k, _, at, _ in sorted((r for r in rows if r[1] == key), key=lambda r: r[2]):
            number += last is None or at - last > timedelta(seconds=600)
            last = at
            assert got[k] == (key, number)
    near = {r.seq: (r.before, r.following) for r in intervals.with_neighbours(frame, ["key"], "seq", F.col("v"), F.col("v") + 1, 7).collect()}
    for key in "ab":
        own = [r for r in rows if r[1] == key]
        for i, (k, *_) in enumerate(own):
            back = own[i - 1][3] if i else None
            assert near[k] == (None if back is None else back + 1, own[i + 1][3] if i + 1 < len(own) else None)


def test_occupancies_in_segments_equal_those_of_one_window(spark):
    rng = random.Random(2)
    rows = [(k, T0 + timedelta(seconds=k), "Z", rng.choice(["CA", "CB", "CC"]), str(rng.randint(0, 3)), str(rng.randint(0, 3)), rng.choice(["1A", "2B", "----"])) for k in range(400)]
    events = spark.createDataFrame(rows, "seq long, event_at timestamp, td_area string, message_type string, from_berth string, to_berth string, descr string")
    assert sorted(map(tuple, berths.occupancies(events, segment=13).collect())) == sorted(map(tuple, berths.occupancies(events).collect()))
    assert pd.DataFrame(berths.anomalies(events).collect()).shape[0] > 50


@pytest.mark.parametrize("pieces", [1, 4])
def test_runs_are_followed_and_lost_after_the_grace(spark, tmp_path, pieces):
    from trackledger.streaming import follow

    second = lambda n: T0 + timedelta(seconds=n)
    at = [
        ("1A", "b1", 0, "enter"), ("1A", "b2", 10, "enter"), ("1A", "b1", 10, "leave"), ("1A", "b2", 20, "leave"), ("1A", "b3", 27, "enter"), ("1A", "b3", 40, "leave"),
        ("2B", "b9", 41, "enter"), ("1A", "b1", 60, "enter"), ("2B", "b9", 100, "leave"), ("3C", "b5", 101, "leave"), ("4D", "b0", 300, "enter"),
    ]
    rows = [(d, "Z", b, second(s), h, k) for k, (d, b, s, h) in enumerate(at)]
    got = run(spark, tmp_path, rows, "descr string, td_area string, berth string, seen_at timestamp, half string, number long", pieces, follow.followed)
    moved = [(r[0], r[3], r[4], r[6]) for r in sorted(got, key=lambda r: r[4]) if r[2] == "moved"]
    assert moved == [("1A", "b1", second(0), 1), ("1A", "b2", second(10), 2), ("1A", "b3", second(27), 3), ("2B", "b9", second(41), 1), ("1A", "b1", second(60), 1), ("4D", "b0", second(300), 1)]
    lost = sorted((r[0], r[4], r[5], r[6]) for r in got if r[2] == "lost")
    assert lost == [("1A", second(48), second(0), 3), ("2B", second(108), second(41), 1)]


def test_sessions_are_logged(spark, tmp_path):
    from trackledger.streaming import sessions

    log = sessions.SessionLog(spark, str(tmp_path / "log"))
    spark.streams.addListener(log)
    try:
        spark.range(5).write.parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))

        def fails(batch, n):
            raise ValueError("no broker")

        good = source.writeStream.queryName("good").foreachBatch(lambda b, n: None).option("checkpointLocation", str(tmp_path / "a")).trigger(availableNow=True).start()
        good.awaitTermination()
        bad = source.writeStream.queryName("bad").foreachBatch(fails).option("checkpointLocation", str(tmp_path / "b")).trigger(availableNow=True).start()
        with pytest.raises(Exception, match="no broker"):
            bad.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        for _ in range(50):
            if len(list((tmp_path / "log").glob("*.json"))) >= 4:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    found = {r.name: r for r in sessions.sessions(spark, str(tmp_path / "log")).collect()}
    assert set(found) == {"good", "bad"} and all(r.opened_at <= r.closed_at for r in found.values())
    assert found["good"].error is None and "no broker" in found["bad"].error


def test_a_stored_history_reads_the_stretches_of_its_days_and_edges(spark, tmp_path):
    from trackledger.operators import history

    rng = random.Random(8)
    rows = [(k, T0 + timedelta(minutes=k + rng.randint(-3, 3)), rng.choice("YZ"), rng.choice(["CA", "CB", "CC"]), str(rng.randint(0, 3)), str(rng.randint(0, 3)), rng.choice(["1A", "2B", "----"])) for k in range(600)]
    events = spark.createDataFrame(rows, "seq long, event_at timestamp, td_area string, message_type string, from_berth string, to_berth string, descr string")
    history.store(events, str(tmp_path / "h"), 40)
    whole = berths.occupancies(events)
    for a, b, area in ((100, 130, None), (0, 599, "Z"), (250, 251, "Y"), (700, 800, None)):
        start, end = (F.lit(T0 + timedelta(minutes=m)).cast("timestamp") for m in (a, b))
        want = whole.where((F.col("entered_at") >= start) & (F.col("entered_at") < end)).where("true" if area is None else f"td_area = '{area}'").drop("entry_type")
        got = history.occupancies_between(spark, str(tmp_path / "h"), start, end, area)
        assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    plan = history.occupancies_between(spark, str(tmp_path / "h"), F.lit(T0 + timedelta(minutes=100)).cast("timestamp"), F.lit(T0 + timedelta(minutes=130)).cast("timestamp"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "stretch" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]


def test_maps_in_effect_and_their_status(spark):
    from trackledger.functions import clock
    from trackledger.operators import maps

    day = lambda n: datetime(2026, 1, n)
    versions = spark.createDataFrame([("m", 1, day(1), day(5)), ("m", 2, day(5), None), ("n", 1, day(1), day(2)), ("o", 1, day(1), None)], "slug string, version int, effective_from timestamp, effective_to timestamp")
    wanted = spark.createDataFrame([("m", day(1)), ("m", day(4)), ("m", day(5)), ("n", day(2)), ("x", day(3))], "slug string, at timestamp")
    got = {(r.slug, r["at"].day): (r.version, r.found) for r in maps.effective_at(versions, wanted).collect()}
    assert got == {("m", 1): (1, True), ("m", 4): (1, True), ("m", 5): (2, True), ("n", 2): (None, False), ("x", 3): (None, False)}
    bound = spark.createDataFrame([("m", "A"), ("m", "B"), ("o", "C")], "slug string, td_area string")
    seen = spark.createDataFrame([("A", day(9)), ("B", day(10))], "td_area string, last_at timestamp")
    now = F.lit(day(10) + timedelta(seconds=60)).cast("timestamp")
    listed = {r.slug: (r.version, r.live_status) for r in maps.listed(versions, bound, seen, now, clock.live_status).collect()}
    assert listed == {"m": (2, "ok"), "o": (1, "unknown")}


@pytest.mark.parametrize("pieces", [1, 5])
def test_occupancy_stream_for_any_split(spark, tmp_path, pieces):
    from trackledger.streaming import berth_state

    rng = random.Random(3)
    rows = [(k, T0 + timedelta(seconds=k), "Z", rng.choice(["CA", "CB", "CC"]), str(rng.randint(0, 3)), str(rng.randint(0, 3)), rng.choice(["1A", "2B", "----"])) for k in range(200)]
    events = spark.createDataFrame(rows, "seq long, event_at timestamp, td_area string, message_type string, from_berth string, to_berth string, descr string")
    touched = berths.touches(events)
    own = sorted((tuple(r) for r in touched.collect()), key=lambda r: r[0])
    got = run(spark, tmp_path, own, touched.schema, pieces, berth_state.occupancy_stream)
    ended = {tuple(r) for r in berths.occupancies(events).where("exit_seq is not null").select("berth", "occupancy_id", "descr", "entered_at", "left_at", "exit_seq", "exit_reason").collect()}
    assert {r[1:8] for r in got if r[2] is not None} == ended
    wrong = {(r.seq, r.berth, r.code) for r in berths.anomalies(events).collect()}
    assert {(r[6], r[1], r[8]) for r in got if r[8]} == wrong
