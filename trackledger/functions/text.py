"""Codes, keys and texts of the feeds as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nonempty(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def headcode(train_id: Column) -> Column:
    """Characters 3 to 6 of a ten-character train id."""
    return F.when(F.length(train_id) == 10, F.substring(train_id, 3, 4))


def object_key(namespace: Column, digest: Column, at: Column) -> Column:
    """Where content of this digest is archived."""
    return F.concat(F.lit("raw/"), namespace, F.lit("/"), F.date_format(at, "yyyy/MM/dd"), F.lit("/"), digest, F.lit(".bin"))


def activity_codes(raw: Column) -> Column:
    """The text in pieces of two characters, the last may have one."""
    return F.regexp_extract_all(raw, F.lit("(.{1,2})"), F.lit(1))


def location_type(raw: Column, index: Column, total: Column) -> Column:
    """origin, destination, pass or intermediate; by position when the code does not say."""
    code = F.upper(F.coalesce(raw, F.lit("")))
    by_place = F.when(index == 0, "origin").when(index == total - 1, "destination").otherwise("intermediate")
    return F.when(code.isin("LO", "OR"), "origin").when(code.isin("LT", "TI"), "destination").when(code.startswith("LP") | (code == "PP"), "pass").otherwise(by_place)


def shown_time(raw: Column) -> Column:
    """``HHMM`` or ``HHMMH`` as ``HH:MM`` with a half minute; a dash without a time, shorter texts as they are."""
    half = F.when(raw.endswith("H"), "½").otherwise("")
    digits = F.length(F.regexp_replace(raw, "H$", ""))
    return F.when(nonempty(raw).isNull(), "—").when(digits < 4, raw).otherwise(F.concat(F.substring(raw, 1, 2), F.lit(":"), F.substring(raw, 3, 2), half))


def shown_location(tiploc: Column, name: Column) -> Column:
    return F.when(nonempty(tiploc).isNull(), "—").when(nonempty(name).isNull(), tiploc).otherwise(F.concat(name, F.lit(" ("), tiploc, F.lit(")")))


def call_or_pass(arrival_public: Column, arrival_working: Column, departure_public: Column, departure_working: Column, pass_public: Column, pass_working: Column, path: Column, line: Column) -> tuple[Column, Column, Column]:
    """(is_call, pass time, path/line) of a row of a schedule: it calls if it has any arrival or departure."""
    booked = F.coalesce(arrival_public, arrival_working, departure_public, departure_working)
    return booked.isNotNull(), F.coalesce(pass_public, pass_working), F.concat_ws("/", nonempty(path), nonempty(line))


# The variation statuses that are understood.
VARIATIONS = ("ON TIME", "EARLY", "LATE", "OFF ROUTE")


def movement_report(payload: Column) -> tuple[Column, Column, Column, Column, Column]:
    """(status, minutes, platform, event type, stanox) of a movement's JSON; minutes only if they are digits, without leading zeros."""
    field = lambda name: nonempty(F.get_json_object(payload, f"$.body.{name}"))
    status, minutes = field("variation_status"), field("timetable_variation")
    minutes = F.when(minutes.rlike("^[0-9]+$"), F.regexp_replace(minutes, "^0+(?=[0-9])", ""))
    return F.when(status.isin(*VARIATIONS), status), minutes, field("platform"), field("event_type"), field("loc_stanox")


def running_indication(status: Column, minutes: Column, fallback: Column) -> Column:
    """What a passenger is told of the last report."""
    some = F.concat(F.lit("approximately "), minutes)
    return (
        F.when(status == "ON TIME", "on time")
        .when(status == "OFF ROUTE", "off route")
        .when((status == "EARLY") & minutes.isNotNull(), F.concat(some, F.lit(" early")))
        .when((status == "LATE") & minutes.isNotNull(), F.concat(some, F.lit(" late")))
        .otherwise(fallback)
    )


def composite_key(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)
