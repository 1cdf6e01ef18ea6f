import json
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trackledger.functions import clock, text
from trackledger.operators import maps, paging, resolver, runs, schedules, tables
from trackledger.streaming import ingest, live

T0 = datetime(2026, 1, 5, 12)


def test_service_dates_follow_london(spark):
    cases = {"2026-01-10T02:30:00": "2026-01-09", "2026-07-10T01:30:00": "2026-07-09", "2026-07-10T02:30:00": "2026-07-10", "2027-01-01T01:00:00": "2026-12-31"}
    rows = spark.createDataFrame(list(cases.items()), "at string, want string")
    assert all(str(r.got) == r.want for r in rows.select("want", clock.service_date(F.col("at").cast("timestamp")).alias("got")).collect())


def test_schedule_precedence(spark):
    day = date(2026, 1, 5)  # a Monday
    rows = [
        (1, "A", day, day, "P", None), (2, "A", day, day, "O", "1000000"), (3, "B", day, day, "P", "0111111"), (4, "C", day, day, "N", ""), (5, "C", day, day, "N", None),
        (6, "D", day, day, "C", None), (7, "D", day, day, "O", None), (8, "E", day + timedelta(1), day + timedelta(9), "P", None),
    ]
    table = spark.createDataFrame(rows, "schedule_id long, train_uid string, start_date date, end_date date, stp string, days_run string")
    got = {r.train_uid: (r.outcome, r.schedule_id) for r in schedules.effective_on(table, "2026-01-05").collect()}
    assert got == {"A": ("matched", 2), "C": ("ambiguous", None), "D": ("matched", 6)}
    wanted = spark.createDataFrame([(u, day) for u in "ABCX"], "train_uid string, day date")
    assert {r.train_uid: r.outcome for r in schedules.lookup(table, wanted).collect()} == {"A": "matched", "B": "unmatched", "C": "ambiguous", "X": "not_found"}


def events(spark, rows):
    return spark.createDataFrame([(s, T0 + timedelta(minutes=s), i, e, date(2026, 1, 5), "1A01", "U", r) for s, i, e, r in rows], "seq long, event_at timestamp, identity string, event_type string, service_date date, signalling_id string, train_uid string, revised_identity string")


def test_runs_are_never_made_up(spark):
    log = events(spark, [(1, "a", "movement", None), (2, "a", "activation", None), (3, "a", "cancellation", None), (4, "a", "activation", None), (5, "a", "reinstatement", None), (6, "b", "movement", None), (7, "c", "unidentified", None), (8, "c", "activation", None)])
    got = {r.identity: (r.state, r.created_seq) for r in runs.runs(log).collect()}
    assert got == {"a": ("activated", 2), "c": ("unidentified", 7)}
    assert {r.event_type: r.n for r in runs.skipped(log).collect()} == {"movement": 2}
    rows = {r.identity: r for r in runs.runs(log).collect()}
    assert rows["a"].n_events == 3 and rows["a"].signalling_id == "1A01"  # the second activation has no effect
    assert (rows["c"].signalling_id, rows["c"].activated_at, rows["c"].train_uid, rows["c"].n_events) == (None, None, None, 1)


def test_identity_changes_follow_chains(spark):
    log = events(spark, [(1, "a", "activation", None), (2, "a", "change_of_identity", "b"), (3, "b", "change_of_identity", "c"), (4, "x", "change_of_identity", "y"), (5, "d", "activation", None), (6, "d", "change_of_identity", "c")])
    got = {r.identity: (r.root_identity, r.created_seq, r.superseded_by) for r in runs.with_identity_changes(log).collect()}
    assert got == {"a": ("a", 1, "b"), "b": ("a", 2, "c"), "c": ("a", 3, None), "d": ("d", 5, "c")}


def test_identity_changes_follow_a_chain_of_any_length(spark):
    n = 68
    log = events(spark, [(1, "i0", "activation", None)] + [(k + 2, f"i{k}", "change_of_identity", f"i{k + 1}") for k in range(n)])
    got = {r.identity: (r.root_identity, r.created_seq, r.superseded_by) for r in runs.with_identity_changes(log).collect()}
    assert got == {f"i{k}": ("i0", k + 1, f"i{k + 1}" if k < n else None) for k in range(n + 1)}


def test_resolution_scores_and_continuity(spark):
    schema = "occupancy_id long, td_area string, berth string, descr string, entered_at timestamp, run_id string, activated_at timestamp, score int"
    early = T0 - timedelta(hours=2)
    rows = [(1, "Z", "1", "1A01", T0, "r1", early, 65), (1, "Z", "1", "1A01", T0, "r2", early, 40)]
    rows += [(2, "Z", "2", "1A01", T0 + timedelta(minutes=5), r, early, 40) for r in ("r1", "r2")]
    rows += [(3, "Z", "3", "1A01", T0 + timedelta(minutes=30), r, early, 40) for r in ("r1", "r2")]
    rows += [(4, "Z", "4", "2B02", T0, "r9", early, 0)]
    scored = spark.createDataFrame(rows, schema)
    occupied = scored.select("occupancy_id").distinct().unionByName(spark.createDataFrame([(5,)], "occupancy_id long"))
    plain = {r.occupancy_id: (r.status, r.run_id) for r in resolver.decide(occupied, scored).collect()}
    assert plain == {1: ("matched", "r1"), 2: ("ambiguous", None), 3: ("ambiguous", None), 4: ("unmatched", None), 5: ("unmatched", None)}
    again = [(1, "Z", "1", "1A01", T0, "r1", early, 65), (2, "Z", "2", "1A01", T0 + timedelta(minutes=3), "r1", early, 40), (2, "Z", "2", "1A01", T0 + timedelta(minutes=3), "r2", early + timedelta(minutes=1), 40)]
    fresher = {r.occupancy_id: (r.status, r.score) for r in resolver.decide_in_order(spark.createDataFrame(again, schema)).collect()}
    assert fresher == {1: ("matched", 65), 2: ("ambiguous", 40)}  # another candidate began later than the run that would be supported
    chained = {r.occupancy_id: (r.status, r.score) for r in resolver.decide_in_order(scored).collect()}
    assert chained == {1: ("matched", 65), 2: ("matched", 70), 3: ("ambiguous", 40), 4: ("unmatched", 0)}


def test_limits_ranges_and_pages(spark):
    assert [paging.parse_limit(x) for x in (None, "7", "0", "-3", "x", 9999, 2.7, "nan")] == [100, 7, 100, 100, 100, 500, 2, 100]
    now = datetime(2026, 1, 10)
    assert paging.parse_range(None, None, now)[0] == datetime(2026, 1, 3)
    for bad in ((now, now), (datetime(2025, 1, 1), now)):
        with pytest.raises(ValueError):
            paging.parse_range(*bad, now)
    rows = spark.range(10).withColumnRenamed("id", "n")
    first = paging.page(rows, "n", None, 4).collect()
    assert [r.n for r in paging.page(rows, "n", paging.next_cursor(first, "n", 4), 4).collect()] == [4, 5, 6, 7]
    assert [r.n for r in paging.page(rows, "n", 3, 2, descending=True).collect()] == [2, 1] and paging.next_cursor(first, "n", 5) is None


def test_upserts_and_reconciliation(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k string, v int, seq int")
    new = spark.createDataFrame([("b", 2, 5), ("b", 3, 6), (None, 9, 7), ("", 8, 8)], "k string, v int, seq int")
    assert sorted((r.k or "", r.v) for r in tables.upsert(old, new, ["k"], "seq").collect()) == [("", 8), ("a", 1), ("b", 3)]
    assert sorted((r.k or "", r.v) for r in tables.insert_new(old.unionByName(new.where("seq = 7")), new.where("seq >= 6").unionByName(spark.createDataFrame([("c", 1, 1)], new.schema)), ["k"]).collect()) == [("c", 1)]
    left = spark.createDataFrame([("m", 1, "a"), ("m", 1, "b"), ("n", 1, "a")], "map_id string, id int, v string")
    assert sorted(tuple(r) for r in tables.diff(left, left.where("not (map_id = 'm' and v = 'b')"), ["map_id", "id"]).collect()) == [("m", 1, "modified")]
    want = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "z")], "object_key string, sha256 string")
    have = spark.createDataFrame([("1", "x"), ("2", "?"), ("4", "w")], "object_key string, sha256 string")
    assert {r.object_key: r.state for r in tables.reconcile(want, have).collect()} == {"1": "ok", "2": "corrupt", "3": "missing", "4": "orphan"}


def test_texts(spark):
    one = spark.range(1)
    shown = [one.select(text.shown_time(F.lit(t))).first()[0] for t in ("1005", "1005H", "9", "", "930H")]
    assert shown == ["10:05", "10:05½", "9", "—", "930H"]
    places = [one.select(text.shown_location(F.lit(t).cast("string"), F.lit(n).cast("string"))).first()[0] for t, n in (("AB", "Abc"), ("AB", ""), ("AB", None), (None, "Abc"))]
    assert places == ["Abc (AB)", "AB", "AB", "—"]
    report = one.select(*text.movement_report(F.lit('{"body": {"variation_status": "LATE", "timetable_variation": "05", "platform": " 4", "event_type": "ARRIVAL", "loc_stanox": "123"}}'))).first()
    assert tuple(report) == ("LATE", "5", " 4", "ARRIVAL", "123")
    assert one.select(text.shown_time(F.lit(None).cast("string"))).first()[0] == "—"
    assert one.select(text.activity_codes(F.lit("TBRMA"))).first()[0] == ["TB", "RM", "A"]
    kinds = [one.select(text.location_type(F.lit(c), F.lit(i), F.lit(3))).first()[0] for c, i in (("LO", 1), ("lt", 0), ("PP", 0), (None, 0), (None, 1), ("", 2))]
    assert kinds == ["origin", "destination", "pass", "origin", "intermediate", "destination"]


def test_map_documents(spark):
    doc = {
        "schemaVersion": 1, "map": {"id": "m", "name": "M"}, "layers": [{"id": "l", "order": 2}],
        "elements": [
            {"id": "b1", "type": "berth", "layerId": "l", "x": 10, "y": 20}, {"id": "b2", "type": "berth", "layerId": "l", "x": 0, "y": 0}, {"id": "b2", "type": "label", "layerId": "gone", "x": 1, "y": 1, "zIndex": 3},
            {"id": "t", "type": "trackPath", "layerId": "l", "points": [{"x": -5, "y": 0}, {"x": 300, "y": 9}]}, {"id": "o", "type": "boundary", "layerId": "l", "x": 0, "y": 0, "adjacentMapSlug": "nowhere"}, {"id": "z", "type": "zap", "layerId": "l"},
        ],
        "bindings": [{"id": "k1", "elementId": "b1", "type": "tdBerth", "tdArea": "ZZ", "berth": "1"}, {"id": "k2", "elementId": "t", "type": "tdBerth", "tdArea": "ZZ", "berth": "1"}, {"id": "k3", "elementId": "b2", "type": "tdSBit", "tdArea": "ZZ", "address": "A", "bit": 1}],
        "topology": {"nodes": [{"id": "n1"}, {"id": "n2"}], "edges": [{"id": "e1", "fromNodeId": "n1", "toNodeId": "n2"}, {"id": "e2", "fromNodeId": "n1", "toNodeId": "?"}]},
    }
    own = maps.read(spark.createDataFrame([("m", json.dumps(doc))], "map_id string, json string"))
    codes = sorted(r.code for r in maps.issues(own).collect())
    assert codes == ["duplicate_berth_binding", "duplicate_element_id", "invalid_berth_binding", "invalid_schema", "missing_layer", "topology_edge_missing_node"]
    box = maps.bounding_boxes(own).first()
    assert (box.min_x, box.max_x, box.width, box.height) == (-5.0, 300.0, 385.0, 100.0)
    assert {r.node: r.neighbours for r in maps.adjacency(own).collect()} == {"n1": ["n2", "?"], "n2": ["n1"]}
    assert {r.key: r.element_id for r in maps.binding_index(own).collect()} == {"ZZ|1": "t", "ZZ|A|1": "b2"}
    assert [r.id for r in maps.painted(own).orderBy("paint_key", "pos").collect()][-1] == "b2"
    seen = spark.createDataFrame([("ZZ", "2")], "td_area string, berth string")
    assert sorted(r.code for r in maps.warnings(own, spark.createDataFrame([("m",)], "slug string"), seen).collect()) == ["binding_never_observed"] * 2 + ["unknown_adjacent_map"]
    doc["elements"][0]["x"] = 11
    del doc["elements"][4]
    changed = maps.read(spark.createDataFrame([("m", json.dumps(doc))], "map_id string, json string"))
    assert {(r.part, r.id, r.change) for r in maps.changes(own, changed).where("id in ('b1', 'o')").collect()} == {("elements", "b1", "modified"), ("elements", "o", "removed")}


def test_versions_do_not_overlap(spark):
    none = spark.createDataFrame([], "slug string, version int, document string, effective_from timestamp, effective_to timestamp")
    one = maps.publish(none, "m", "{}", "2026-01-01", spark)
    two = maps.publish(one, "m", "{}", "2026-02-01", spark)
    assert [(r.version, r.effective_to is None) for r in two.orderBy("version").collect()] == [(1, False), (2, True)]
    assert maps.overlapping_versions(two).count() == 0
    with pytest.raises(ValueError):
        maps.publish(two, "m", "{}", "2026-01-15", spark)


def test_live_state(spark):
    snapshot = spark.createDataFrame([("m", "e1", "1A01", 5), ("m", "e2", None, 5)], "slug string, element_id string, descr string, sequence long")
    deltas = spark.createDataFrame([("m", "e1", None, 6), ("m", "e2", "2B02", 7), ("m", "e2", "old", 4), ("m", "e9", "x", 8)], snapshot.schema)
    folded = live.folded(snapshot, deltas)
    assert {r.element_id: r.descr for r in folded.collect()} == {"e1": None, "e2": "2B02"}
    assert {(r.element_id, r.message, r.sequence) for r in live.poll_deltas(snapshot, folded).collect()} == {("e1", "berth.cleared", 6), ("e2", "berth.updated", 7)}
    polled = "slug string, element_id string, descr string, entered_at timestamp, sequence long"
    before = spark.createDataFrame([("m", "e1", "1A01", T0, 5), ("m", "e2", "2B02", T0, 7)], polled)
    now = spark.createDataFrame([("m", "e0", None, None, 0), ("m", "e1", "1A01", T0 + timedelta(minutes=9), 30), ("m", "e2", "2B02", T0, 7), ("m", "e3", "3C03", T0, 6)], polled)
    assert [tuple(r) for r in live.poll_deltas(before, now).orderBy("sequence").collect()] == [
        ("m", "e0", "berth.cleared", None, 8), ("m", "e1", "berth.updated", "1A01", 30), ("m", "e3", "berth.updated", "3C03", 31),
    ]
    server = spark.createDataFrame([("m", 2, 9)], "slug string, version int, sequence long")
    clients = spark.createDataFrame([("m", 2, 9), ("m", 1, 5), ("m", 2, 12)], server.schema)
    assert live.needs_resync(clients, server).count() == 2
    assert json.loads(live.messages(deltas).first().value)["element_id"] == "e1"


def test_landing_a_stream_twice_records_once(spark, tmp_path):
    from trackledger.sources.frames import parse_td

    body = json.dumps([{"CT_MSG": {"area_id": "ZZ", "report_time": "1"}}])
    rows = spark.createDataFrame([("td", body, T0), ("td", body, T0), ("td", "[]", T0)], "feed_name string, body string, received_at timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        ingest.land_stream(source, parse_td, str(tmp_path / "log"), str(tmp_path / "checkpoint")).awaitTermination()
    rows.write.mode("append").parquet(str(tmp_path / "in"))
    ingest.land_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), parse_td, str(tmp_path / "log"), str(tmp_path / "checkpoint")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log/frames")).count() == 2
    assert spark.read.parquet(str(tmp_path / "log/children")).count() == 2


def test_schedules_meet_trains_and_dates_not_runs(spark):
    """Runs of one train and date share one lookup, so links grow with the runs, not with runs times schedules."""
    own = spark.range(40).selectExpr("concat('r', id) as run_id", "if(id = 0, null, concat('U', id % 2)) as train_uid", "date'2026-01-05' as service_date")
    plans = spark.createDataFrame([("U0", 1, "P", "2026-01-01", "2026-01-31"), ("U0", 2, "O", "2026-01-01", "2026-01-31"), ("U1", 3, "P", "2026-01-01", "2026-01-31"), ("U1", 4, "P", "2026-01-05", "2026-01-05")], "train_uid string, schedule_id long, stp string, a string, b string")
    plans = plans.selectExpr("train_uid", "schedule_id", "stp", "to_date(a) as start_date", "to_date(b) as end_date", "cast(null as string) as days_run")
    links = schedules.link_runs(own, plans)
    assert "keys=[run_id" not in links._jdf.queryExecution().executedPlan().toString()
    want = {f"r{k}": ("unmatched", None) if k == 0 else ("ambiguous", None) if k % 2 else ("matched", 2) for k in range(40)}
    assert {r.run_id: (r.outcome, r.schedule_id) for r in links.collect()} == want


def resolver_tables(spark, seed, n=120):
    """Occupancies, runs, links, calls and berths in which all kinds of candidates and ties come up, some times and keys missing."""
    rng = random.Random(seed)
    at = lambda: T0 + timedelta(minutes=rng.choice([0, 1, 5, 9, 30, 300, 1440, 1441]) + rng.randint(0, 12))
    occ = [(k, rng.choice("YZ"), rng.choice("12"), rng.choice(["1A01", "2B02"]), None if k == 7 else at()) for k in range(n)]
    own = [(f"r{k}", rng.choice(["1A01", "2B02", None]), (T0 + timedelta(days=rng.randint(0, 1))).date(), rng.choice(["activated", "activated", "superseded"]), rng.choice([None, T0 - timedelta(days=1), T0, T0 + timedelta(minutes=3), at(), at()])) for k in range(rng.choice([4, 9, 24]))]
    links = [(r[0], *rng.choice([("matched", rng.randint(1, 4)), ("ambiguous", None), ("unmatched", None)])) for r in own]
    calls = [(rng.randint(1, 4), rng.choice(["S1", "S2", "S3", None])) for _ in range(5)]
    smart = [(a, b, rng.choice(["S1", "S2", "S3", None])) for a in "YZ" for b in "12"]
    return (
        spark.createDataFrame(occ, "occupancy_id long, td_area string, berth string, descr string, entered_at timestamp"), spark.createDataFrame(own, "run_id string, signalling_id string, service_date date, state string, activated_at timestamp"),
        spark.createDataFrame(links, "run_id string, outcome string, schedule_id long"), spark.createDataFrame(calls, "schedule_id long, stanox string"), spark.createDataFrame(smart, "td_area string, to_berth string, stanox string"),
    )


def rows_of(found):
    return sorted(tuple(r) for r in found.select("occupancy_id", "status", F.coalesce("run_id", F.lit("")).alias("run_id"), "score", "confidence", "n_candidates").collect())


@pytest.mark.parametrize("seed", range(2))
def test_the_best_of_each_occupancy_without_pairs(spark, seed):
    made = [t.persist() for t in resolver_tables(spark, seed)]
    pairs, best, facts = resolver.candidates(*made), resolver.tops(*made), resolver.run_facts(*made[1:])
    assert rows_of(resolver.decide_tops(best)) == rows_of(resolver.decide(made[0], pairs))
    walked = rows_of(resolver.decide_in_order(pairs))
    assert rows_of(resolver.decide_tops_in_order(best, facts)) == walked
    won = [r for r in walked if r[1] == "matched"][::2]
    fixed = spark.createDataFrame([(r[0], r[2]) for r in won], "occupancy_id long, run_id string").join(made[0], "occupancy_id").persist()
    left = lambda rows: rows.join(fixed.select("occupancy_id"), "occupancy_id", "left_anti")
    assert rows_of(resolver.decide_tops_in_order(left(best), facts, fixed=fixed)) == rows_of(resolver.decide_in_order(left(pairs), fixed=fixed))
    assert "keys=[occupancy_id" not in pairs._jdf.queryExecution().executedPlan().toString() and "_smart" not in pairs._jdf.queryExecution().toString()


def test_pairs_are_compared_without_arithmetic_on_times(spark):
    """Ends of journeys belong to runs, of which there are fewer than pairs."""
    at = lambda name, value: F.lit(value).cast("timestamp_ntz").alias(name)
    key = [F.lit("1A00").alias("descr"), F.lit("2026-01-01").cast("date").alias("service_date")]
    occ = spark.range(3).select(F.col("id").alias("occupancy_id"), *key, (F.lit("2026-01-01 10:00").cast("timestamp_ntz") + F.make_dt_interval(F.col("id").cast("int") - 1)).alias("entered_at"))
    own = spark.range(1).select(F.lit("r").alias("run_id"), *key, at("activated_at", "2026-01-01 10:00"))
    pairs = resolver.plausible(occ, own)
    assert sorted(r.occupancy_id for r in pairs.collect()) == [1, 2]
    from trackledger.plans import ALL_QUERIES

    plan = ALL_QUERIES["joi_08_plausible_runs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert [line for line in plan.splitlines() if "Join" in line] and not [line for line in plan.splitlines() if "Join" in line and "INTERVAL" in line]


def test_only_months_with_runs_meet_schedules(spark):
    """Schedules of other months are dropped before the shuffle, by months that are a broadcast."""
    own = spark.createDataFrame([("r1", "U1", date(2026, 1, 31)), ("r2", "U1", date(2026, 3, 1)), ("r3", None, date(2026, 3, 1)), ("r4", "U1", None)], "run_id string, train_uid string, service_date date")
    plans = [("U1", 1, "P", date(2025, 11, 1), date(2026, 1, 31)), ("U1", 2, "O", date(2026, 3, 1), date(2026, 3, 1)), ("U1", 3, "C", date(2026, 2, 1), date(2026, 2, 28))]
    plans = spark.createDataFrame(plans, "train_uid string, schedule_id long, stp string, start_date date, end_date date").withColumn("days_run", F.lit(None).cast("string"))
    links = schedules.link_runs(own, plans)
    assert {r.run_id: (r.outcome, r.schedule_id) for r in links.collect()} == {"r1": ("matched", 1), "r2": ("matched", 2), "r3": ("unmatched", None), "r4": ("unmatched", None)}
    lines = links._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("Join LeftSemi" in line and "_month" in line and "broadcast" in line for line in lines)


def test_runs_of_decisions_are_found_once(spark):
    from trackledger.plans import ALL_QUERIES

    plan = ALL_QUERIES["res_03_resolution"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("user_id") and "created_seq" not in plan


@pytest.mark.parametrize("seed", range(2))
def test_wanted_occupancies_are_decided_as_among_all(spark, seed):
    occ, *made = [t.persist() for t in resolver_tables(spark, seed)]
    wanted = occ.where("occupancy_id % 3 = 0")
    few = resolver.decide_tops(resolver.tops(wanted, *made), "td_area", "berth")
    assert rows_of(few) == rows_of(resolver.decide_tops(resolver.tops(occ, *made)).join(wanted, "occupancy_id", "left_semi"))
    where = lambda rows: sorted(tuple(r) for r in rows.select("occupancy_id", "td_area", "berth").collect())
    assert where(few) == where(wanted)


@pytest.mark.parametrize("name", ["joi_06_recent_resolutions", "joi_07_last_match", "srt_06_retry_backlog", "red_19_resolution_deltas", "str_06_recent_decisions"])
def test_who_asks_for_some_decisions_makes_occupancies_once(spark, name):
    from trackledger.plans import ALL_QUERIES

    plan = ALL_QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len([line for line in plan.splitlines() if "Relation" in line and "event_id" in line]) == 1


def test_due_occupancies_meet_known_decisions_once(spark):
    from trackledger.plans import ALL_QUERIES

    plan = ALL_QUERIES["res_06_due"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len([line for line in plan.splitlines() if "Join" in line and "occupancy_id" in line]) == 1


def test_calls_of_schedules_without_runs_are_not_shuffled(spark):
    """Which schedules have runs is written, so that its size is known and the join on calls needs no shuffle while it is small."""
    from trackledger.plans import feeds

    _, _, calls, _ = feeds._evidence(spark, "/root/testdata/sf0.001")
    plan = calls._jdf.queryExecution().optimizedPlan()
    joined = [line for line in plan.toString().splitlines() if "Join LeftSemi" in line]
    assert len(joined) == 1 and "Relation [schedule_id" in plan.toString()
    assert "SortMergeJoin" not in calls._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed", range(2))
def test_texts_of_candidates_equal_the_pairs(spark, seed):
    """Runs of a description and date come once to a part of its occupancies, and nothing is evaluated in the plan for each pair."""
    occ, own, *rest = (t.persist() for t in resolver_tables(spark, seed))
    own = own.withColumn("told", F.concat(F.lit("U"), "run_id"))
    want = {}
    for r in resolver.candidates(occ, own, *rest).collect():
        want.setdefault(r.occupancy_id, []).append((-r.score, r.run_id))
    found = resolver.candidate_texts(occ, own, *rest, told="told")
    assert {r.occupancy_id: r.candidates for r in found.collect()} == {k: ",".join(f"{run}:{-down}:U{run}" for down, run in sorted(v)) for k, v in want.items()}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "array_contains" not in plan


def test_pairs_are_made_in_blocks_of_runs(spark, monkeypatch):
    """However many runs a key has, a join meets a block of them; reasons are constants, not evaluated one by one."""
    monkeypatch.setattr(resolver, "BLOCK", 3)
    key = [F.when(F.col("id") % 5 != 0, (F.col("id") % 2).cast("string")).alias("descr"), F.lit(date(2026, 1, 1)).alias("service_date")]
    occ = spark.range(20).select(F.col("id").alias("occupancy_id"), *key)
    own = spark.range(20).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("run_id"), *key)
    found = resolver.paired(occ, own, ["descr", "service_date"], "run_id")
    here = [k for k in range(20) if k % 5]
    assert sorted((r.occupancy_id, r.run_id) for r in found.collect()) == sorted((a, f"r{b}") for a in here for b in here if a % 2 == b % 2)
    assert "_block" in found._jdf.queryExecution().optimizedPlan().toString()
    made = resolver_tables(spark, 1)
    assert "lambda" not in resolver.candidates(*made)._jdf.queryExecution().optimizedPlan().toString()
