"""Berth occupancy from train-describer steps.

A step into a berth sets its content, a step out of it or a cancel clears it, whatever it
held before.  So the state before a touch is the state after the one before it, and an
occupancy ends at the next touch: ``lag`` and ``lead`` over the touches of a berth in
order of arrival, with no sequential fold.  Berths are independent, so a shuffle on
(area, berth) is the only one; arrival order counts, never the message's own time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackledger.operators.intervals import with_neighbours

EMPTY = "----"
KEY = ["td_area", "berth"]


def _order(descending: bool = False):
    return Window.partitionBy(*KEY).orderBy(F.col("seq").desc() if descending else F.col("seq"))


def touches(events: DataFrame) -> DataFrame:
    """One row per berth that a CA, CB or CC message touches, in one scan.

    A CA from a berth to itself touches it once, as a step into it.
    """
    kind, own = F.col("message_type"), F.col("from_berth") == F.col("to_berth")

    def touch(when: Column, berth: str, half: str, reason: Column) -> Column:
        opens = (F.lit(half) == "to") & (F.col("descr") != EMPTY)
        return F.when(when, F.struct(F.col(berth).alias("berth"), F.lit(half).alias("half"), opens.alias("opens"), reason.alias("reason")))

    leaves = touch((kind == "CB") | (kind == "CA") & ~own, "from_berth", "from", F.when(kind == "CB", "cancelled").otherwise("stepped_out"))
    enters = touch(kind.isin("CA", "CC"), "to_berth", "to", F.when(kind == "CA", "overwritten_by_step").otherwise("overwritten_by_interpose"))
    checked = (F.col("descr") != EMPTY) & ((F.col("_t.half") == "from") | (kind == "CA") & own)
    return (
        events.where(kind.isin("CA", "CB", "CC"))
        .withColumn("_t", F.explode(F.filter(F.array(leaves, enters), lambda t: t.isNotNull())))
        .select("seq", "event_at", "td_area", "message_type", "descr", "_t.*", checked.alias("checked"))
        .where(F.col("berth").isNotNull())
    )


def _with_states(touched: DataFrame, segment: int | None = None) -> DataFrame:
    following = F.struct("event_at", "seq", "reason")
    if segment:
        return with_neighbours(touched, KEY, "seq", following, F.when(F.col("opens"), F.col("descr")), segment, ("before", "_next"))
    return touched.withColumn("before", F.lag(F.when(F.col("opens"), F.col("descr"))).over(_order())).withColumn("_next", F.lead(following).over(_order()))


def occupancies(events: DataFrame, segment: int | None = None) -> DataFrame:
    """(occupancy_id, td_area, berth, descr, entered_at, entry_type, left_at, exit_seq, exit_reason); open ones have no exit.

    With ``segment``, a berth's history is worked on in stretches of so many sequence numbers,
    for logs in which one berth's touches are too many for a task.
    """
    return (
        _with_states(touches(events), segment)
        .where("opens")
        .select(
            F.col("seq").alias("occupancy_id"),
            *KEY,
            "descr",
            F.col("event_at").alias("entered_at"),
            F.when(F.col("message_type") == "CA", "ca_step").otherwise("cc_interpose").alias("entry_type"),
            F.col("_next.event_at").alias("left_at"),
            F.col("_next.seq").alias("exit_seq"),
            F.col("_next.reason").alias("exit_reason"),
        )
    )


def anomalies(events: DataFrame) -> DataFrame:
    """(seq, event_at, td_area, berth, expected, found, code): steps from a berth that did not hold what was said."""
    held = F.col("before")
    return (
        _with_states(touches(events))
        .where(F.col("checked") & ~held.eqNullSafe(F.col("descr")))
        .select("seq", "event_at", *KEY, F.col("descr").alias("expected"), held.alias("found"), F.when(held.isNull(), "from_berth_empty").otherwise("from_berth_description_mismatch").alias("code"))
    )


def current_state(events: DataFrame) -> DataFrame:
    """(td_area, berth, descr, event_at, source_seq): berths that were ever filled, as their last occupancy left them."""
    last = F.max_by(F.struct("descr", "entered_at", "left_at", "exit_seq", "occupancy_id"), "occupancy_id").alias("o")
    still = F.col("o.exit_seq").isNull()
    return (
        occupancies(events)
        .groupBy(*KEY)
        .agg(last)
        .select(
            *KEY,
            F.when(still, F.col("o.descr")).alias("descr"),
            F.coalesce("o.left_at", "o.entered_at").alias("event_at"),
            F.coalesce("o.exit_seq", "o.occupancy_id").alias("source_seq"),
        )
    )


def heartbeats(events: DataFrame) -> DataFrame:
    """(td_area, seq, event_at) of the CT messages."""
    return events.where(F.col("message_type") == "CT").select("td_area", "seq", "event_at").dropDuplicates(["td_area", "seq"])


def area_health(events: DataFrame) -> DataFrame:
    """(td_area, n, last_at): messages of each area, and its last heartbeat, if it had one."""
    return events.groupBy("td_area").agg(F.count("*").alias("n"), F.max(F.when(F.col("message_type") == "CT", F.col("event_at"))).alias("last_at"))


def followed_legs(occupied: DataFrame, gap: str, key: tuple[str, ...] = ("descr", "td_area")) -> DataFrame:
    """(key, first_at, last_at, n_berths): stretches of a description in an area whose entries are no further apart than an interval."""
    order = Window.partitionBy(*key).orderBy("entered_at", "occupancy_id")
    opens = F.coalesce(F.col("entered_at") - F.lag("entered_at").over(order) > F.expr(f"INTERVAL {gap}"), F.lit(False))
    legs = occupied.withColumn("_opens", opens).withColumn("_leg", F.sum(F.col("_opens").cast("int")).over(order))
    return legs.groupBy(*key, "_leg").agg(F.min("entered_at").alias("first_at"), F.max("entered_at").alias("last_at"), F.count("*").alias("n_berths")).drop("_leg")


def signalling_state(events: DataFrame) -> DataFrame:
    """(td_area, address, data, event_at, seq): the last byte of each address by arrival."""
    last = F.max_by(F.struct("data", "event_at", "seq"), "seq").alias("s")
    return events.groupBy("td_area", "address").agg(last).select("td_area", "address", "s.*")


def berth_changes(events: DataFrame) -> DataFrame:
    """(seq, event_at, td_area, berth, descr): what each message says changed; a cleared berth has no descr.

    Here, unlike in the state, the empty description is published as it is.
    """
    kind = F.col("message_type")
    cleared = F.when(kind.isin("CA", "CB"), F.struct(F.lit(0).alias("n"), F.col("from_berth").alias("berth"), F.lit(None).cast("string").alias("descr")))
    updated = F.when(kind.isin("CA", "CC"), F.struct(F.lit(1).alias("n"), F.col("to_berth").alias("berth"), F.col("descr")))
    rows = events.withColumn("_c", F.explode(F.filter(F.array(cleared, updated), lambda c: c.isNotNull())))
    return rows.select("seq", "event_at", "td_area", F.col("_c.n").alias("n"), F.col("_c.berth").alias("berth"), F.col("_c.descr").alias("descr"))


def with_clears(events: DataFrame, clears: DataFrame) -> DataFrame:
    """The live view's touches with operators' manual clears (seq, event_at, td_area, berth) among them; rebuilds leave these out."""
    extra = clears.select("seq", "event_at", "td_area", F.lit("CLEAR").alias("message_type"), F.lit(EMPTY).alias("descr"), "berth", F.lit("from").alias("half"), F.lit(False).alias("opens"), F.lit("manual_operator_clear").alias("reason"), F.lit(False).alias("checked"))
    return touches(events).unionByName(extra)


def valid_clears(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clears, refused) of requests (seq, event_at, td_area, berth, reason): a clear needs a reason, which is trimmed."""
    given = F.coalesce(F.trim("reason"), F.lit("")) != ""
    return requests.where(given).withColumn("reason", F.trim("reason")), requests.where(~given)


def clear_actions(events: DataFrame, clears: DataFrame) -> DataFrame:
    """(seq, event_at, td_area, berth, reason, closed_occupancy_id, closed_entered_at, previous_descr): the audit row of each clear.

    What it closed is the occupancy that was open at that point of the live view, earlier
    clears included; a clear of a vacant berth closed nothing, and is recorded all the same.
    """
    held = F.when(F.col("opens"), F.struct(F.col("seq").alias("id"), "event_at", "descr"))
    rows = with_clears(events, clears).withColumn("_held", F.lag(held).over(_order())).where("message_type = 'CLEAR'")
    rows = rows.select("seq", "event_at", *KEY, F.col("_held.id").alias("closed_occupancy_id"), F.col("_held.event_at").alias("closed_entered_at"), F.col("_held.descr").alias("previous_descr"))
    return rows.join(clears.select("seq", *KEY, "reason"), ["seq", *KEY])
