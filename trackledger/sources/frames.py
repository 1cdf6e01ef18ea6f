"""Broker frames to child events, without ever losing one.

A frame is (feed_name, body, received_at); its body is text or gzip.  Every frame yields at
least one child: a body that can't be read yields one ``malformed`` child with the reason,
and children of an unknown kind are kept as ``unsupported``.  The child's own JSON text is
kept as it came, and its hash names its content.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackledger.functions import clock

PARSE_VERSION = 1
# Wrapper keys and message types as they are on the wire.
TD_KINDS = {"CA_MSG": "CA", "CB_MSG": "CB", "CC_MSG": "CC", "CT_MSG": "CT"}
TRUST_KINDS = {
    "0001": "activation", "0002": "cancellation", "0003": "movement", "0005": "unidentified", "0006": "reinstatement",
    "0007": "change_of_origin", "0008": "change_of_identity", "0009": "change_of_location",
}
TRUST_TIMES = ("actual_timestamp", "creation_timestamp", "canx_timestamp", "reinstatement_timestamp", "origin_dep_timestamp", "event_timestamp")
VSTP_KINDS = {"Create": "vstp.create", "Overwrite": "vstp.overwrite", "Delete": "vstp.delete", "Update": "vstp.update"}
CHILD = ["feed_name", "body_hash", "received_at", "child_index", "event_type", "message_class", "td_area", "raw_event", "raw_time", "event_at", "correction_code", "correction_details", "semantic_hash", "parse_status", "error_code"]


def _unpacked(column: Column) -> Column:
    """Texts of gzip bodies, null where gzip fails."""

    @F.arrow_udf("string")
    def unpack(bodies: pa.Array) -> pa.Array:
        texts = []
        for body in bodies.to_pylist() if bodies.null_count < len(bodies) else []:
            try:
                texts.append(None if body is None else gzip.decompress(body).decode("utf-8", "replace"))
            except (OSError, EOFError, zlib.error):
                texts.append(None)
        return pa.array(texts, pa.string()) if texts else pa.nulls(len(bodies), pa.string())

    return unpack(column)


def computed_once(rows: DataFrame, **columns: Column) -> DataFrame:
    """The rows with further columns, each computed once a row, whatever is asked of it later.

    Spark writes what a column is made of into every filter and column that names it, so that
    a parsed text would be parsed for each of them; it does not do so across a generator.
    """
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def texts_of(frames: DataFrame) -> DataFrame:
    """``text`` and ``body_hash`` of each frame; text is null where gzip fails.  Only gzip bodies leave the JVM."""
    frames = computed_once(frames.select("feed_name", F.col("body").alias("_body"), "received_at"), body=F.col("_body").cast("binary")).drop("_body")
    packed = F.coalesce(F.substring("body", 1, 2) == F.lit(bytes([0x1F, 0x8B])), F.lit(False))
    frames = frames.withColumn("body_hash", F.sha2("body", 256)).withColumn("_unpacked", _unpacked(F.when(packed, F.col("body"))))
    frames = computed_once(frames, text=F.when(packed, F.col("_unpacked")).otherwise(F.coalesce(F.col("body").cast("string"), F.lit(""))))
    return frames.select("feed_name", "received_at", "body_hash", "text")


def is_kind(value: Column, kind: str) -> Column:
    """Whether a variant is an OBJECT, an ARRAY or a STRING; of the first two only the top is looked at, not what is in them."""
    top = {"OBJECT": "map<string,variant>", "ARRAY": "array<variant>"}
    if kind in top:
        return F.try_variant_get(value, "$", top[kind]).isNotNull()
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _string(payload: Column, name: str) -> Column:
    """The member of a JSON object, if it is a string."""
    member = F.variant_get(payload, f"$.{name}", "variant")
    return F.when(is_kind(member, "STRING"), F.variant_get(payload, f"$.{name}", "string"))


def _children(frames: DataFrame) -> DataFrame:
    """A row per element of each body's array, or one row with the reason why there is none."""
    whole = F.col("_whole")
    reason = (
        F.when(F.col("text").isNull(), "gzip_decompress_failed")
        .when(whole.isNull(), "invalid_json")
        .when(~is_kind(whole, "ARRAY"), "not_an_array")
        .when(F.size(F.from_json("text", "array<string>")) == 0, "empty_array")
    )
    rows = computed_once(computed_once(texts_of(frames), _whole=F.try_parse_json("text")), frame_error=reason).drop("_whole")
    values = F.when(F.col("frame_error").isNull(), F.arrays_zip(F.from_json("text", "array<string>").alias("raw"), F.from_json("text", "array<variant>").alias("value")))
    rows = rows.select("*", F.posexplode_outer(values).alias("child_index", "_c"))
    raw = F.coalesce("_c.raw", F.when(F.col("frame_error").isNotNull(), F.substring("text", 1, 2000)))
    return rows.withColumn("child_index", F.coalesce("child_index", F.lit(0))).withColumn("raw_event", raw).withColumn("value", F.col("_c.value"))


def _finished(rows: DataFrame, event_type: Column, status: Column, error: Column, raw_time: Column, message_class: Column | None = None, area: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = computed_once(rows, event_type=event_type, parse_status=status, error_code=error, raw_time=raw_time, message_class=message_class if message_class is not None else none, td_area=area if area is not None else none)
    at, code, details = clock.normalized(F.col("raw_time"), F.col("received_at"))
    rows = rows.withColumns({"event_at": at, "correction_code": code, "correction_details": details, "semantic_hash": F.sha2(F.coalesce("raw_event", F.lit("null")), 256)})
    return rows.select(*CHILD)


def parse_td(frames: DataFrame) -> DataFrame:
    """Train-describer children: C class (CA, CB, CC, CT), S class, or unsupported."""
    rows = _children(frames)
    rows = rows.withColumn("_m", F.when(is_kind(F.col("value"), "OBJECT"), F.from_json("raw_event", "map<string,variant>")))
    rows = rows.withColumn("_key", F.when(F.size("_m") == 1, F.element_at(F.map_keys("_m"), 1))).withColumn("_p", F.element_at(F.map_values("_m"), 1))
    payload = F.col("_p")
    kind = F.create_map(*[F.lit(x) for pair in TD_KINDS.items() for x in pair])[F.col("_key")]
    rows = rows.withColumns({"_kind": kind, "_area": _string(payload, "area_id"), "_from": _string(payload, "from"), "_to": _string(payload, "to"), "_descr": _string(payload, "descr"), "_time": _string(payload, "time"), "_report": _string(payload, "report_time")})
    is_c, is_s = F.col("_kind").isNotNull(), F.coalesce(F.col("_key").rlike("^S[A-Z]_MSG$"), F.lit(False))
    an_object = is_kind(payload, "OBJECT") | is_kind(payload, "ARRAY")
    time = F.when(~an_object, None).when(is_c, F.coalesce("_time", "_report")).when(is_s, F.col("_time"))
    has = lambda *names: F.lit(True) if not names else F.col(names[0]).isNotNull() & has(*names[1:])
    complete = (
        F.when(F.col("_kind") == "CA", has("_from", "_to", "_descr")).when(F.col("_kind") == "CB", has("_from", "_descr")).when(F.col("_kind") == "CC", has("_to", "_descr")).otherwise(has("_report"))
    )
    area = F.nullif("_area", F.lit(""))
    error = (
        F.when(F.col("frame_error").isNotNull(), F.col("frame_error"))
        .when(F.col("_m").isNull(), "child_not_an_object")
        .when(F.col("_key").isNull(), "unexpected_wrapper_key_count")
        .when((is_c | is_s) & ~an_object, "payload_not_object")
        .when(is_c & (area.isNull() | F.nullif(time, F.lit("")).isNull() | ~complete), "missing_required_field")
        .when(is_s & area.isNull(), "missing_area_id")
    )
    event_type = F.coalesce("_kind", "_key", F.lit("unknown"))
    status = F.when(error.isNotNull(), "malformed").when(is_c | is_s, "parsed").otherwise("unsupported")
    message_class = F.when(is_c, "C").when(is_s, "S")
    return _finished(rows, event_type, status, error, time, message_class, F.when(is_c | is_s, F.col("_area")))


def parse_trust(frames: DataFrame) -> DataFrame:
    """Running-information children by ``header.msg_type``."""
    rows = _children(frames)
    rows = rows.withColumn("_m", F.when(is_kind(F.col("value"), "OBJECT"), F.from_json("raw_event", "header variant, body variant")))
    header, body = F.col("_m.header"), F.col("_m.body")
    kind = F.nullif(_string(header, "msg_type"), F.lit(""))
    error = (
        F.when(F.col("frame_error").isNotNull(), F.col("frame_error"))
        .when(F.col("_m").isNull(), "child_not_an_object")
        .when(~is_kind(header, "OBJECT"), "missing_or_invalid_header")
        .when(~is_kind(body, "OBJECT"), "missing_or_invalid_body")
        .when(kind.isNull(), "missing_msg_type")
    )
    known = F.create_map(*[F.lit(x) for pair in TRUST_KINDS.items() for x in pair])[kind]
    event_type = F.when(error.isNotNull(), "unknown").otherwise(F.coalesce(known, F.concat(F.lit("trust.unsupported_msg_type:"), kind)))
    status = F.when(error.isNotNull(), "malformed").when(known.isNotNull(), "parsed").otherwise("unsupported")
    time = F.when(error.isNull(), F.coalesce(*[F.nullif(_string(body, t), F.lit("")) for t in TRUST_TIMES]))
    return _finished(rows, event_type, status, error, time)


def parse_vstp(frames: DataFrame) -> DataFrame:
    """Very-short-term-plan messages: one child per frame."""
    rows = computed_once(texts_of(frames), value=F.try_parse_json("text")).withColumn("raw_event", F.col("text")).withColumn("child_index", F.lit(0))
    rows = computed_once(rows, _m=F.when(is_kind(F.col("value"), "OBJECT"), F.from_json("text", "map<string,variant>")))
    rows = rows.withColumn("_key", F.element_at(F.map_keys("_m"), 1)).withColumn("_p", F.element_at(F.map_values("_m"), 1))
    ours = F.col("_key") == "VSTPCIFMsgV1"
    schedule = F.variant_get("_p", "$.schedule", "variant")
    error = (
        F.when(F.col("text").isNull(), "gzip_decompress_failed")
        .when(F.col("value").isNull(), "invalid_json")
        .when(F.col("_m").isNull(), "not_an_object")
        .when(F.size("_m") != 1, "unexpected_root_element_count")
        .when(ours & ~(is_kind(F.col("_p"), "OBJECT") | is_kind(F.col("_p"), "ARRAY")), "root_payload_not_object")
        .when(ours & (schedule.isNull() | F.is_variant_null(schedule)), "missing_schedule_element")
    )
    rows = computed_once(rows, _error=error, _kind=F.variant_get("_p", "$.schedule.transaction_type", "string"))
    error, kind = F.col("_error"), F.col("_kind")
    known = F.create_map(*[F.lit(x) for pair in VSTP_KINDS.items() for x in pair])[kind]
    event_type = (
        F.when(error.isNotNull(), "unknown").when(~ours, F.concat(F.lit("vstp.unsupported_root:"), F.col("_key"))).otherwise(F.coalesce(known, F.concat(F.lit("vstp.unknown:"), F.coalesce(kind, F.lit("undefined")))))
    )
    status = F.when(error.isNotNull(), "malformed").when(ours & known.isNotNull(), "parsed").otherwise("unsupported")
    time = F.when(ours & error.isNull(), F.variant_get("_p", "$.timestamp", "string"))
    return _finished(rows, event_type, status, error, time)


#: The parser of each feed; further feeds register theirs here.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"td": parse_td, "trust": parse_trust, "vstp": parse_vstp}


def land(frames: DataFrame, recorded: DataFrame | None = None) -> DataFrame:
    """New frames alone: redelivered bodies, within the batch or recorded before, are left out."""
    frames = frames.withColumn("body_hash", F.sha2(F.col("body").cast("binary"), 256)).dropDuplicates(["feed_name", "body_hash"])
    if recorded is not None:
        frames = frames.join(recorded.select("feed_name", "body_hash").distinct(), ["feed_name", "body_hash"], "left_anti")
    return frames


def frame_summary(children: DataFrame) -> DataFrame:
    """(feed_name, body_hash, n, n_parsed, n_unsupported, n_malformed, last_event_at, status) of each frame."""
    by = {s: F.count_if(F.col("parse_status") == s) for s in ("parsed", "unsupported", "malformed")}
    bad, n = by["malformed"], F.count("*")
    status = F.when(bad == 0, "ok").when(bad == n, "failed").otherwise("partial")
    return children.groupBy("feed_name", "body_hash").agg(n.alias("n"), *[c.alias(f"n_{s}") for s, c in by.items()], F.max("event_at").alias("last_event_at"), status.alias("status"))


def td_steps(children: DataFrame) -> DataFrame:
    """The train-describer view of parsed C-class children; ``seq`` must be given to them before."""
    part = lambda name: F.coalesce(*[F.get_json_object("raw_event", f"$.{k}.{name}") for k in TD_KINDS])
    rows = children.where((F.col("parse_status") == "parsed") & (F.col("message_class") == "C"))
    return rows.select("seq", "event_at", "td_area", F.col("event_type").alias("message_type"), part("from").alias("from_berth"), part("to").alias("to_berth"), part("descr").alias("descr"))
