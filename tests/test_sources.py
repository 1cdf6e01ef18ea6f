import gzip
import json
from datetime import datetime

import pytest

from pyspark.sql import functions as F

from trackledger.sources import files, frames

NOW = datetime(2026, 8, 10, 12)
MS = str(int((NOW - datetime(1970, 1, 1)).total_seconds() * 1000))


def made(spark, *bodies, feed="td"):
    rows = [(feed, b if isinstance(b, (bytes, bytearray)) else b.encode(), NOW) for b in bodies]
    return spark.createDataFrame([(f, bytearray(b), t) for f, b, t in rows], "feed_name string, body binary, received_at timestamp")


def td(kind, **fields):
    return {kind: fields}


def outcomes(df):
    return sorted((r.child_index, r.event_type, r.message_class, r.td_area, r.parse_status, r.error_code) for r in df.collect())


def test_td_children_are_classified_and_never_lost(spark):
    body = json.dumps([
        td("CA_MSG", area_id="ZZ", time=MS, **{"from": "0001"}, to="0002", descr="1A01"), td("CB_MSG", area_id="ZZ", time=MS, **{"from": "0001"}),
        td("CT_MSG", area_id="ZZ", report_time=MS), td("SF_MSG", area_id="ZZ", address="0A", data="FF"), td("SG_MSG", address="0A"),
        td("XX_MSG", a=1), {"CA_MSG": 1}, {"a": 1, "b": 2}, 5, None, "text", [1], td("CC_MSG", area_id="ZZ", time=7, to="0001", descr="x"),
    ])
    got = outcomes(frames.parse_td(made(spark, body)))
    assert [(g[1], g[4], g[5]) for g in got] == [
        ("CA", "parsed", None), ("CB", "malformed", "missing_required_field"), ("CT", "parsed", None), ("SF_MSG", "parsed", None), ("SG_MSG", "malformed", "missing_area_id"),
        ("XX_MSG", "unsupported", None), ("CA", "malformed", "payload_not_object"), ("unknown", "malformed", "unexpected_wrapper_key_count"), *[("unknown", "malformed", "child_not_an_object")] * 4,
        ("CC", "malformed", "missing_required_field"),
    ]
    assert got[0][2:4] == ("C", "ZZ") and got[3][2:4] == ("S", "ZZ")


def test_each_unreadable_body_gives_one_malformed_child(spark):
    bad = {"{": "invalid_json", "{}": "not_an_array", "[]": "empty_array", "": "invalid_json"}
    for body, code in bad.items():
        assert [(g[4], g[5]) for g in outcomes(frames.parse_td(made(spark, body)))] == [("malformed", code)]
    broken = bytes([0x1F, 0x8B, 1, 2])
    assert outcomes(frames.parse_td(made(spark, broken)))[0][5] == "gzip_decompress_failed"
    packed = gzip.compress(json.dumps([td("CT_MSG", area_id="ZZ", report_time=MS)]).encode())
    assert outcomes(frames.parse_td(made(spark, packed)))[0][1] == "CT"


def test_times_are_corrected_only_where_unusable(spark):
    late = str(int(MS) - 25 * 3_600_000)
    body = json.dumps([td("CT_MSG", area_id="ZZ", report_time=t) for t in (MS, "-1", "x", late)])
    rows = sorted(frames.parse_td(made(spark, body)).collect(), key=lambda r: r.child_index)
    assert [r.correction_code for r in rows] == ["none", "unparseable", "unparseable", "implausible_skew"]
    assert all(r.event_at == NOW for r in rows)


def test_trust_children(spark):
    def message(kind, body):
        return {"header": {"msg_type": kind}, "body": body}

    body = json.dumps([message("0001", {"creation_timestamp": MS}), message("0003", {"actual_timestamp": "", "event_timestamp": MS}), message("0099", {}), message("0002", None), {"body": {}}, {"header": {}, "body": {}}, 1])
    got = outcomes(frames.parse_trust(made(spark, body, feed="trust")))
    assert [(g[1], g[4], g[5]) for g in got] == [
        ("activation", "parsed", None), ("movement", "parsed", None), ("trust.unsupported_msg_type:0099", "unsupported", None), ("unknown", "malformed", "missing_or_invalid_body"),
        ("unknown", "malformed", "missing_or_invalid_header"), ("unknown", "malformed", "missing_msg_type"), ("unknown", "malformed", "child_not_an_object"),
    ]


def test_vstp_frames(spark):
    def one(body):
        return outcomes(frames.parse_vstp(made(spark, body if isinstance(body, str) else json.dumps(body), feed="vstp")))

    def root(**x):
        return {"VSTPCIFMsgV1": x}

    cases = [
        (root(timestamp=MS, schedule={"transaction_type": "Create"}), ("vstp.create", "parsed", None)), (root(schedule={"transaction_type": "Zap"}), ("vstp.unknown:Zap", "unsupported", None)),
        ({"Other": {}}, ("vstp.unsupported_root:Other", "unsupported", None)), (root(), ("unknown", "malformed", "missing_schedule_element")), ({"VSTPCIFMsgV1": 1}, ("unknown", "malformed", "root_payload_not_object")),
        ([], ("unknown", "malformed", "not_an_object")), ({"a": 1, "b": 2}, ("unknown", "malformed", "unexpected_root_element_count")), ("nope", ("unknown", "malformed", "invalid_json")),
    ]
    for body, want in cases:
        (got,) = one(body)
        assert (got[1], got[4], got[5]) == want


def test_landing_leaves_out_redeliveries(spark):
    three = made(spark, "[]", "[]", "{}")
    first = frames.land(three)
    assert first.count() == 2 and frames.land(three, first).count() == 0
    summary = {r.status for r in frames.frame_summary(frames.parse_td(first)).collect()}
    assert summary == {"failed"}


def test_schedule_files(spark, tmp_path):
    call = {"location_type": "LO", "tiploc_code": "AAA", "departure": "1000"}
    good = {"JsonScheduleV1": {"transaction_type": "Create", "CIF_train_uid": "U1", "schedule_start_date": "2026-01-01", "schedule_end_date": "2026-02-01", "CIF_stp_indicator": "P", "schedule_days_runs": "1111100", "schedule_segment": {"schedule_location": [call, call | {"tiploc_code": "BBB"}]}}}
    gone = {"JsonScheduleV1": {"transaction_type": "Delete", "CIF_train_uid": "U1"}}
    lines = [json.dumps({"JsonTimetableV1": {}}), json.dumps(good), "", json.dumps(gone), json.dumps({"JsonScheduleV1": {"CIF_train_uid": "U2"}}), json.dumps({"TiplocV1": {}}), "{broken", json.dumps({"EOF": True})]
    (tmp_path / "full.jsonl").write_text("\n".join(lines))
    records = files.schedule_records(files.numbered_lines(spark, str(tmp_path / "full.jsonl")))
    assert [(r.line_no, r.record_type) for r in records.orderBy("line_no").collect()] == [(1, "header"), (2, "schedule"), (4, "schedule"), (5, "schedule"), (6, "tiploc"), (7, "malformed"), (8, "trailer")]
    assert files.is_complete(records) and not files.is_complete(records.where("line_no < 8"))
    typed, other = files.schedules(records)
    assert [(r.train_uid, r.origin, r.destination) for r in typed.collect()] == [("U1", "AAA", "BBB")]
    assert sorted(r.line_no for r in other.collect()) == [5, 6, 7]
    assert [r.tiploc_code for r in files.calls_of(typed).orderBy("seq_no").collect()] == ["AAA", "BBB"]


def test_reference_files(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"TIPLOCDATA": [{"TIPLOC": "AAA", "STANOX": "1", "NLCDESC": "old"}, {"TIPLOC": "AAA", "STANOX": " ", "NLCDESC": "new"}, {"TIPLOC": " "}]}))
    (tmp_path / "s.json").write_text(json.dumps({"BERTHDATA": [{"TD": "ZZ", "FROMBERTH": "1", "TOBERTH": "2", "STANOX": "9"}, {"TD": "ZZ", "FROMBERTH": "1", "TOBERTH": "2", "STANOX": "8"}]}))
    assert [tuple(r) for r in files.locations(spark, str(tmp_path / "c.json")).select("tiploc", "stanox", "name").collect()] == [("AAA", None, "new")]
    assert [(r.td_area, r.stanox) for r in files.berth_steps(spark, str(tmp_path / "s.json")).collect()] == [("ZZ", "8")]
    with pytest.raises(ValueError):
        files.locations(spark, str(tmp_path / "s.json"))


def test_children_are_joined_without_a_broadcast_of_the_log(spark):
    """Estimates fall below the limit of broadcasts while rows do not."""
    from trackledger.operators import imports
    from trackledger.plans.documents import _children

    made = spark.createDataFrame([(k, "td", f"[{k}]") for k in range(3)], "frame long, feed_name string, body string").withColumn("received_at", F.lit("2026-01-01").cast("timestamp"))
    parsed = frames.parse_td(made)
    for rows in (_children(parsed, made), imports.reparsed(parsed, parsed.withColumn("event_type", F.lit("x")))):
        assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString() and rows.count() == 3


def test_bodies_are_parsed_once_whatever_is_asked_of_them(spark):
    """Spark writes what a column is made of into every filter on it, unless it is computed once."""
    from trackledger.sources import records

    made = spark.createDataFrame([("td", "[1]")], "feed_name string, body string").withColumn("received_at", F.lit("2026-01-01").cast("timestamp"))
    plan = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString()
    shown = plan(records.vstp_calls(records.vstp_schedules(frames.parse_vstp(made)), ["body_hash"]))
    assert shown.count("parseJson") == 2 and shown.count("from_json") + shown.count("jsontostructs") <= 1
    assert plan(frames.parse_trust(made).where("parse_status = 'parsed' and event_type = 'movement'")).count("parseJson") == 1


def test_lines_of_a_file_in_pieces_are_numbered_on(spark, tmp_path):
    for name, lines in (("b/part-00001", "4"), ("a/part-00002", "3\n\n"), ("a/part-00000", "1\n2\n"), ("b/part-00003", "5\n6")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(lines)
    rows = files.numbered_lines(spark, str(tmp_path / "*"), pieces=True)
    assert sorted((r.file[-1], r.line_no, r.line) for r in rows.collect()) == [("a", 1, "1"), ("a", 2, "2"), ("a", 3, "3"), ("a", 4, ""), ("b", 1, "4"), ("b", 2, "5"), ("b", 3, "6")]


def test_a_schedule_file_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from trackledger.plans import storage

    monkeypatch.setattr(storage, "_folder", lambda spark, name: str(tmp_path / name))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    monkeypatch.setattr(storage, "FILES", 1)
    try:
        storage._schedule_files(spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len([*(tmp_path / "schedules" / "part=0").glob("part-*")]) == 4
