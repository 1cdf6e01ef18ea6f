"""Live map state for clients: a snapshot, then the deltas after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def after_snapshot(deltas: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The deltas (slug, sequence, ...) that a client still needs: those beyond its map's snapshot sequence."""
    taken = snapshot.groupBy("slug").agg(F.max("sequence").alias("_taken"))
    return deltas.join(taken, "slug", "left").where(F.col("sequence") > F.coalesce("_taken", F.lit(-1))).drop("_taken")


def folded(snapshot: DataFrame, deltas: DataFrame) -> DataFrame:
    """(slug, element_id, descr, sequence): the snapshot with its deltas applied; deltas of unknown elements are ignored."""
    last = after_snapshot(deltas, snapshot).groupBy("slug", "element_id").agg(F.max_by(F.struct("descr", "sequence"), "sequence").alias("d"))
    rows = snapshot.join(last, ["slug", "element_id"], "left")
    changed = F.col("d").isNotNull()
    return rows.select("slug", "element_id", F.when(changed, F.col("d.descr")).otherwise(F.col("descr")).alias("descr"), F.when(changed, F.col("d.sequence")).otherwise(F.col("sequence")).alias("sequence"))


def binding_deltas(changes: DataFrame, bindings: DataFrame) -> DataFrame:
    """(slug, element_id, seq, n, message, descr): what the changes of berths mean to each element that is bound to one.

    ``changes``: (seq, n, td_area, berth, descr), a null descr clears; ``bindings``: (slug, element_id, td_area, berth).
    """
    kind = F.when(F.col("descr").isNull(), "berth.cleared").otherwise("berth.updated")
    return changes.join(bindings, ["td_area", "berth"]).select("slug", "element_id", "seq", "n", kind.alias("message"), "descr")


def client_state(deltas: DataFrame, after: Column) -> DataFrame:
    """(slug, element_id, descr, seq): each element as its last delta beyond a sequence left it; an empty descr if cleared."""
    rows = deltas.where(F.col("seq") > after).withColumn("descr", F.coalesce("descr", F.lit("")))
    return rows.groupBy("slug", "element_id").agg(F.max_by("descr", F.struct("seq", "n")).alias("descr"), F.max("seq").alias("seq"))


def poll_deltas(before: DataFrame, now: DataFrame) -> DataFrame:
    """(slug, element_id, message, descr, sequence): what changed between two polls of (slug, element_id, descr, entered_at, sequence).

    An element changes with its description or the time of entry, so one left and entered
    again by the same train counts, and so does an element's first row.  The changes of a map,
    by element, get one rising sequence: what was observed, or one more than the one before if
    that is not higher; it begins after the last poll's.  A map's elements are one partition.
    """
    entered = lambda df: F.col("entered_at") if "entered_at" in df.columns else F.lit(None).cast("timestamp_ntz")
    old = before.select("slug", "element_id", F.col("descr").alias("_descr"), entered(before).alias("_entered"), F.lit(True).alias("_known"))
    taken = before.groupBy("slug").agg(F.max("sequence").alias("_taken"))
    both = now.withColumn("_now", entered(now)).join(old, ["slug", "element_id"], "left").join(taken, "slug", "left")
    same = F.col("_known") & F.col("descr").eqNullSafe(F.col("_descr")) & F.col("_now").eqNullSafe(F.col("_entered"))
    rows = both.where(~F.coalesce(same, F.lit(False)))
    order = Window.partitionBy("slug").orderBy("element_id")
    rows = rows.withColumn("_i", F.row_number().over(order))
    ahead = F.max(F.col("sequence") - F.col("_i")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    message = F.when(F.col("descr").isNull(), "berth.cleared").otherwise("berth.updated")
    return rows.select("slug", "element_id", message.alias("message"), "descr", (F.col("_i") + F.greatest(F.coalesce("_taken", F.lit(0)), ahead)).alias("sequence"))


def needs_resync(client: DataFrame, server: DataFrame) -> DataFrame:
    """Clients (slug, version, sequence) whose map has another version, or that are ahead of the server."""
    now = server.select("slug", F.col("version").alias("_version"), F.col("sequence").alias("_sequence"))
    return client.join(now, "slug").where((F.col("version") != F.col("_version")) | (F.col("sequence") > F.col("_sequence"))).select(*client.columns)


def messages(deltas: DataFrame) -> DataFrame:
    """(topic, value) for a message sink."""
    return deltas.select(F.concat(F.lit("live:"), F.col("slug")).alias("topic"), F.to_json(F.struct(*deltas.columns), {"ignoreNullFields": "false"}).alias("value"))
