"""Times and dates of the feeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A railway day begins at this hour of local time.
DAY_STARTS_HOUR = 3
ZONE = "Europe/London"
#: Source times further than this from the receipt are not believed.
MAX_SKEW_HOURS = 24


def service_date(at: Column) -> Column:
    """The railway day of a UTC time."""
    return F.to_date(F.from_utc_timestamp(at, ZONE) - F.expr(f"INTERVAL {DAY_STARTS_HOUR} HOURS"))


def normalized(raw: Column, received_at: Column) -> tuple[Column, Column, Column]:
    """(time, code, details) of epoch milliseconds as text: unusable or implausible times become the receipt's."""
    millis = raw.try_cast("double")
    usable = millis.isNotNull() & (millis > 0) & (millis < 8.64e15) & ~F.isnan(millis)
    at = F.timestamp_millis(F.floor(F.when(usable, millis)).cast("long"))
    skew = F.abs(F.unix_millis(at) - F.unix_millis(received_at))
    late = skew > MAX_SKEW_HOURS * 3_600_000
    code = F.when(~F.coalesce(usable, F.lit(False)), "unparseable").when(late, "implausible_skew").otherwise("none")
    details = F.when(code == "unparseable", F.concat(F.lit("raw="), F.coalesce(raw, F.lit("null")))).when(code == "implausible_skew", F.concat(F.lit("skew_ms="), skew.cast("string")))
    return F.when(code == "none", at).otherwise(received_at), code, details


def month_bounds(at: Column) -> tuple[Column, Column, Column]:
    """(start, end, yyyy_MM) of the time's month."""
    start = F.date_trunc("month", at)
    return F.to_date(start), F.to_date(F.add_months(start, 1)), F.date_format(at, "yyyy_MM")


def live_status(last: Column, now: Column, fresh_seconds: int = 90) -> Column:
    """unknown without data, ok while fresh, else stale."""
    age = F.unix_millis(now) - F.unix_millis(last)
    return F.when(last.isNull(), "unknown").when(age <= fresh_seconds * 1000, "ok").otherwise("stale")


def retry_delay(attempt: Column, base: float, most: float, jitter: Column) -> Column:
    """Exponential back-off up to a limit, 20 % either way by a jitter from 0 to 1."""
    plain = F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt))
    return F.round(plain * (F.lit(0.8) + F.lit(0.4) * jitter))
