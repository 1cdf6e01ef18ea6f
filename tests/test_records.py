"""Records from frames, and the resolver's driver, on small cases."""

import json

from pyspark.sql import functions as F

from trackledger.operators import imports, maps, resolver, tables
from trackledger.sources import frames, records


def framed(spark, feed, bodies):
    rows = spark.createDataFrame([(feed, b if isinstance(b, str) else json.dumps(b)) for b in bodies], "feed_name string, body string")
    return rows.withColumn("received_at", F.lit("2026-01-01").cast("timestamp"))


def plan(segments, **changes):
    schedule = {"transaction_type": "Create", "CIF_train_uid": "U1", "schedule_start_date": "2026-01-01", "schedule_end_date": "2026-02-01", "CIF_stp_indicator": "O", "schedule_days_runs": "1111100"}
    return {"VSTPCIFMsgV1": {"schedule": {k: v for k, v in (schedule | {"schedule_segment": segments} | changes).items() if v is not None}}}


def call(tiploc, **more):
    return {"location": {"tiploc": {"tiploc_id": tiploc}}, **more}


def test_schedules_tolerate_objects_and_arrays_and_keep_the_order_of_segments(spark):
    two = [{"signalling_id": "1A00", "schedule_location": [call("A", CIF_activity="TBT"), call("B", scheduled_pass_time="1200")]}, {"signalling_id": "2B00", "schedule_location": call("C", CIF_platform=4)}]
    rows = records.vstp_schedules(frames.parse_vstp(framed(spark, "vstp", [plan(two)])))
    assert [(r.operation, r.train_uid, str(r.start_date), r.stp, r.signalling_id) for r in rows.collect()] == [("create", "U1", "2026-01-01", "O", "1A00")]
    calls = records.vstp_calls(rows, ["train_uid"]).orderBy("seq_no").collect()
    assert [(c.seq_no, c.kind, c.tiploc, c.activity_codes, c.pass_working, c.platform) for c in calls] == [(1, "origin", "A", ["TB", "T"], None, None), (2, "intermediate", "B", [], "1200", None), (3, "destination", "C", [], None, None)]


def test_schedules_without_a_whole_key_are_left_out(spark):
    bodies = [plan(None, CIF_train_uid="U2"), plan([], CIF_stp_indicator="X"), plan([], CIF_train_uid=7), plan([], schedule_end_date=None), plan({"schedule_location": [{}]}, CIF_train_uid="U3"), "no json", "", plan("text", CIF_train_uid="U4", transaction_type="Delete")]
    rows = records.vstp_schedules(frames.parse_vstp(framed(spark, "vstp", bodies)))
    assert {(r.train_uid, r.operation, len(r.calls)) for r in rows.collect()} == {("U2", "create", 0), ("U3", "create", 1), ("U4", "delete", 0)}
    assert [(c.train_uid, c.tiploc) for c in records.vstp_calls(rows, ["train_uid"]).collect()] == [("U3", "")]


def test_identities_of_each_message(spark):
    def message(kind, **body):
        return {"header": {"msg_type": kind}, "body": body}

    body = [
        message("0001", train_id="871A00MX01", train_uid="U1", toc_id=5, train_call_type="AUTOMATIC"), message("0001", train_id="short", train_uid=""), message("0003", train_id="", current_train_id="B"),
        message("0002", train_id="ignored", train_info={"train_id": "C"}), message("0008", current_train_id="D", revised_train_id="E"), message("0008", train_info={"train_id": "F"}, current_train_id="D", revised_train_id="G"),
        message("0006", train_info="text"), message("0099", train_id="H"),
    ]
    rows = records.trust_identities(frames.parse_trust(framed(spark, "trust", [body]))).orderBy("child_index").collect()
    assert [(r.train_id, r.old_train_id, r.new_train_id, r.train_uid, r.signalling_id, r.operator_code, r.call_type) for r in rows] == [
        ("871A00MX01", None, None, "U1", "1A00", None, "AUTOMATIC"), ("short", None, None, None, None, None, None), ("B", None, None, None, None, None, None),
        ("C", None, None, None, None, None, None), (None, "D", "E", None, None, None, None), (None, "F", "G", None, None, None, None), (None,) * 7,
    ]


def test_signals_fall_back_to_their_type_and_payload(spark):
    body = [{"SF_MSG": {"area_id": "A1", "address": "0F", "data": "A0"}}, {"SG_MSG": {"area_id": "A1", "address": 5}}, {"CT_MSG": {"area_id": "A1", "report_time": "1"}}]
    rows = records.td_signals(frames.parse_td(framed(spark, "td", [body]))).orderBy("child_index").collect()
    assert [(r.address, r.data) for r in rows] == [("0F", "A0"), ("SG_MSG", '{"area_id":"A1","address":5}')]


def test_the_driver_decides_new_and_stale_open_occupancies_only(spark):
    occ = spark.createDataFrame([(1, None), (2, None), (3, 9), (4, None), (5, None), (6, None)], "occupancy_id long, exit_seq long")
    known = spark.createDataFrame([(1, "unmatched", "2026-01-01 11:54:59"), (2, "matched", "2026-01-01 10:00:00"), (3, "unmatched", "2026-01-01 10:00:00"), (4, "ambiguous", "2026-01-01 11:55:00"), (5, "ambiguous", "2026-01-01 11:00:00")], "occupancy_id long, status string, at string")
    known = known.select("occupancy_id", "status", F.lit(None).cast("string").alias("run_id"), F.lit(0).alias("score"), F.lit(0.0).alias("confidence"), F.lit(0).cast("long").alias("n_candidates"), F.col("at").cast("timestamp_ntz").alias("decided_at"))
    now = F.lit("2026-01-01 12:00:00").cast("timestamp_ntz")
    due = resolver.due(occ, known, now)
    assert {(r.occupancy_id, r.phase) for r in due.collect()} == {(1, "retry"), (5, "retry"), (6, "new")}
    scored = spark.createDataFrame([(5, "r", 40), (6, "q", 35), (6, "s", 35)], "occupancy_id long, run_id string, score int")
    after = {r.occupancy_id: (r.status, r.run_id) for r in resolver.resolve_due(known, due, scored, now).collect()}
    assert after == {1: ("unmatched", None), 2: ("matched", None), 3: ("unmatched", None), 4: ("ambiguous", None), 5: ("matched", "r"), 6: ("ambiguous", None)}


def test_insert_or_get_returns_existing_ids(spark):
    old = spark.createDataFrame([("a", 1), (None, 2)], "k string, id long")
    new = spark.createDataFrame([("a", 8), ("b", 7), ("b", 6), (None, 9)], "k string, id long")
    assert {(r.k, r.id) for r in tables.insert_or_get(old, new, ["k"], "id").collect()} == {("a", 1), ("b", 6), (None, 2)}
    assert tables.insert_or_get(old, new.limit(0), ["k"], "id").count() == 0


def test_drafts_begin_from_the_version_or_blank(spark):
    wanted = spark.createDataFrame([("a",), ('b"',), ("c",), ("a",)], "slug string")
    drafts = spark.createDataFrame([("c", 4, "mine", 2)], "slug string, revision int, document string, base_version int")
    current = spark.createDataFrame([("a", 3, "published"), ("c", 3, "published")], "slug string, version int, document string")
    found = {r.slug: r for r in maps.seeded_drafts(wanted, drafts, current).collect()}
    assert (found["a"].revision, found["a"].document, found["a"].base_version) == (1, "published", 3)
    assert (found["c"].revision, found["c"].document, found["c"].base_version) == (4, "mine", 2)
    assert json.loads(found['b"'].document)["map"]["id"] == 'b"' and len(found) == 3
    saved = imports.save_draft(spark.createDataFrame([("a", 1, found["a"].document)], "slug string, revision int, document string"), "a", 1, "next", spark)
    assert saved.where("revision = 2").first().document == "next"


def test_logs_of_imports_saves_and_versions(spark):
    rows = [("k", "a", 1, False), ("k", "a", 2, True), ("k", "a", 3, False), ("k", "a", 4, True), ("k", "b", 5, False), ("j", "a", 6, False)]
    tries = spark.createDataFrame(rows, "source_kind string, checksum string, seq long, ok boolean")
    assert [r.decision for r in imports.import_decisions(tries).orderBy("seq").collect()] == ["failed", "completed", "skipped", "skipped", "failed", "failed"]
    saves = spark.createDataFrame([("m", 1, 0), ("m", 2, 0), ("m", 3, 1), ("n", 4, 1), ("n", 5, 0), (None, 6, 0), ("m", 7, None)], "slug string, seq long, base_revision long")
    assert [(r.accepted, r.revision) for r in imports.accepted_saves(saves).orderBy("seq").collect()] == [(True, 1), (False, 1), (True, 2), (False, 0), (True, 1), (True, 1), (False, 2)]
    asked = spark.createDataFrame([("m", 1, "2026-01-05"), ("m", 2, "2026-01-05"), ("m", 3, "2026-01-01"), ("m", 4, "2026-01-09"), ("n", 5, "2026-01-01")], "slug string, seq long, effective_from string")
    got = [(r.seq, r.version, r.effective_from, r.effective_to) for r in maps.published(asked).orderBy("seq").collect()]
    assert got == [(1, 1, "2026-01-05", "2026-01-09"), (4, 2, "2026-01-09", None), (5, 1, "2026-01-01", None)]
