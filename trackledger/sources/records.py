"""Parsed children to the records that the projections read.

Each function takes children of ``frames.PARSERS`` with whatever further columns they have
(an arrival number ``seq``, say), leaves out those that are not parsed or not of its kind,
and adds the record's columns.  A member counts only if it is a JSON string and not empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackledger.functions import text
from trackledger.operators.schedules import PRECEDENCE
from trackledger.sources.frames import computed_once, is_kind

# Members of a call as they are on the wire, by the names used here.
CALL_TEXTS = {
    "arrival_public": "public_arrival_time", "arrival_working": "scheduled_arrival_time", "departure_public": "public_departure_time",
    "departure_working": "scheduled_departure_time", "pass_working": "scheduled_pass_time", "platform": "CIF_platform", "path": "CIF_path",
    "line": "CIF_line", "activity": "CIF_activity",
}
SEGMENT_TEXTS = {"signalling_id": "signalling_id", "service_code": "CIF_train_service_code", "category": "CIF_train_category", "power_type": "CIF_power_type"}
SCHEDULE_TEXTS = {"train_uid": "CIF_train_uid", "start_text": "schedule_start_date", "end_text": "schedule_end_date", "stp": "CIF_stp_indicator", "days_run": "schedule_days_runs", "status": "train_status"}
ACTIVATION_TEXTS = {"call_type": "train_call_type", "call_mode": "train_call_mode", "operator_code": "toc_id", "service_code": "train_service_code"}


def _member(value: Column, path: str) -> Column:
    return F.variant_get(value, f"$.{path}", "variant")


def _text(value: Column, path: str, empty: bool = False) -> Column:
    """A string member; an empty one is null unless asked for."""
    found = F.when(is_kind(_member(value, path), "STRING"), F.variant_get(value, f"$.{path}", "string"))
    return found if empty else text.nonempty(found)


def _listed(value: Column, name: str) -> Column:
    """An array member as it is, a single object as an array of one, anything else as an empty array."""
    member = _member(value, name)
    none = F.array().cast("array<variant>")
    return F.coalesce(F.try_variant_get(value, f"$.{name}", "array<variant>"), F.when(is_kind(member, "OBJECT"), F.array(member)), none)


def trust_identities(children: DataFrame) -> DataFrame:
    """Children of running information with who they are about.

    Adds ``train_id``, ``old_train_id`` and ``new_train_id`` (a change of identity has these
    two only), and what an activation alone tells: ``train_uid``, ``signalling_id`` (the
    headcode in a train id of ten characters), ``call_type``, ``call_mode``,
    ``operator_code`` and ``service_code``.
    """
    rows = children.where(F.col("parse_status") == "parsed").withColumn("_b", F.variant_get(F.try_parse_json("raw_event"), "$.body", "variant"))
    body, kind = F.col("_b"), F.col("event_type")
    own, inner, now = _text(body, "train_id"), _text(body, "train_info.train_id"), _text(body, "current_train_id")
    changes, activates = kind == "change_of_identity", kind == "activation"
    train_id = F.when(kind.isin("activation", "unidentified"), own).when(kind == "movement", F.coalesce(own, now)).when(~changes, inner)
    told = {name: F.when(activates, _text(body, member)) for name, member in ACTIVATION_TEXTS.items()}
    rows = rows.withColumns({
        "train_id": train_id, "old_train_id": F.when(changes, F.coalesce(inner, now)), "new_train_id": F.when(changes, _text(body, "revised_train_id")),
        "train_uid": F.when(activates, _text(body, "train_uid")), "signalling_id": F.when(activates, text.headcode(own)), **told,
    })
    return rows.drop("_b")


def vstp_schedules(children: DataFrame) -> DataFrame:
    """Children of very-short-term plans with the schedule in them; those without a whole natural key are left out.

    Adds ``operation`` (create, overwrite, delete or update), ``train_uid``, ``start_date``,
    ``end_date``, ``stp``, ``days_run``, ``status``, the first segment's ``signalling_id``,
    ``service_code``, ``category`` and ``power_type``, and ``calls``: the calls of all
    segments in order.  Segments and calls may be arrays or one object.
    """
    rows = children.where((F.col("parse_status") == "parsed") & F.col("event_type").startswith("vstp."))
    rows = computed_once(rows, _s=F.variant_get(F.try_parse_json("raw_event"), "$.VSTPCIFMsgV1.schedule", "variant"))
    rows = computed_once(rows, _g=_listed(F.col("_s"), "schedule_segment"), **{name: _text(F.col("_s"), member, empty=True) for name, member in SCHEDULE_TEXTS.items()})
    rows = rows.where(F.col("train_uid").isNotNull() & F.col("start_text").isNotNull() & F.col("end_text").isNotNull() & F.col("stp").isin(*PRECEDENCE))
    first = F.get("_g", F.lit(0))
    rows = rows.withColumns({
        "operation": F.substring_index("event_type", ".", -1), "start_date": F.col("start_text").try_cast("date"), "end_date": F.col("end_text").try_cast("date"),
        **{name: _text(first, member, empty=True) for name, member in SEGMENT_TEXTS.items()},
        "calls": F.flatten(F.transform("_g", lambda g: _listed(g, "schedule_location"))),
    })
    return rows.drop("_s", "_g", "start_text", "end_text")


def vstp_calls(schedules: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq_no from 1, kind, tiploc, times, platform, path, line, activity, activity_codes): a row per call of ``vstp_schedules``.

    ``kind`` is the call's type by its place among the schedule's calls; the wire has no code for it.
    """
    rows = computed_once(schedules.select(*keys, "calls"), _n=F.size("calls"))  # so that no call brings all calls along
    rows = rows.select(*keys, "_n", F.posexplode("calls").alias("_i", "_l")).withColumn("seq_no", F.col("_i") + 1)
    call = F.col("_l")
    texts = {name: _text(call, member, empty=True) for name, member in CALL_TEXTS.items()}
    tiploc = F.coalesce(_text(call, "location.tiploc.tiploc_id", empty=True), F.lit(""))
    kind = text.location_type(F.lit(None).cast("string"), F.col("_i"), F.col("_n"))
    rows = rows.select(*keys, "seq_no", kind.alias("kind"), tiploc.alias("tiploc"), *[c.alias(n) for n, c in texts.items()])
    return rows.withColumn("activity_codes", F.coalesce(text.activity_codes(F.col("activity")), F.array().cast("array<string>")))


def td_signals(children: DataFrame) -> DataFrame:
    """Signalling children with ``address`` (without one, their type) and ``data`` as it came (without any, the payload's JSON)."""
    rows = children.where((F.col("parse_status") == "parsed") & (F.col("message_class") == "S"))
    whole = F.element_at(F.map_values(F.from_json("raw_event", "map<string,string>")), 1)
    payload = F.try_parse_json(whole)
    return rows.withColumns({"address": F.coalesce(_text(payload, "address", empty=True), "event_type"), "data": F.coalesce(_text(payload, "data", empty=True), whole)})
