"""Train runs from activation, movement and lifecycle messages, in order of arrival.

A run exists from the first message that creates it for (identity, service date); later
messages touch it, messages before it are skipped and never make one up, and a repeated
activation has no effect.  A run that an unidentified message creates has no signalling id,
train or time of activation.

Events with a column ``revised_identity`` may have changes of identity: if the run of the
old identity exists at that point it is superseded, and a run under the new one takes its
signalling id, operator and service code, but no time of activation and no train; an
existing run of that identity is reused.  The message belongs to the new run, and so do
later messages of its identity.  Later messages of the old identity still touch the old run,
and a cancellation or reinstatement after the change replaces its state.

Everything but the creations along a chain of changes is a window or an aggregate over the
messages of one run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackledger.session import kept

KEY = ["identity", "service_date"]
CREATES = ("activation", "unidentified")
CHANGE = "change_of_identity"
#: What a run takes from the one it was changed from, as far as the events have it.
CARRIED = ("signalling_id", "operator_code", "service_code")


def _marked(events: DataFrame) -> DataFrame:
    created = F.min(F.when(F.col("event_type").isin(*CREATES), F.col("seq"))).over(Window.partitionBy(*KEY))
    return events.withColumn("created_seq", created)


def _again() -> Column:
    return (F.col("event_type") == "activation") & (F.col("seq") > F.col("created_seq"))


def _run_id() -> Column:
    return F.concat_ws("|", F.col("identity").cast("string"), F.col("service_date").cast("string"))


def runs(events: DataFrame) -> DataFrame:
    """(run_id, identity, service_date, signalling_id, train_uid, state, created_seq, activated_at, last_event_at, n_events).

    With changes of identity also (superseded_by, root_identity), and the operator and service code if the events have them.
    """
    if "revised_identity" in events.columns:
        return _with_changes(events)
    own = _marked(events).where(F.col("seq") >= F.col("created_seq")).where(~_again())
    activated = lambda c: F.min(F.when((F.col("seq") == F.col("created_seq")) & (F.col("event_type") == "activation"), F.col(c))).alias(c)
    state = F.max_by(
        F.when(F.col("event_type") == "cancellation", "cancelled").when(F.col("event_type") == "reinstatement", "activated").otherwise(F.when(F.col("event_type") == "unidentified", "unidentified").otherwise("activated")),
        F.when(F.col("event_type").isin("cancellation", "reinstatement") | (F.col("seq") == F.col("created_seq")), F.col("seq")),
    )
    return own.groupBy(*KEY).agg(
        _run_id().alias("run_id"),
        activated("signalling_id"),
        activated("train_uid"),
        state.alias("state"),
        F.min("created_seq").alias("created_seq"),
        activated("event_at").alias("activated_at"),
        F.max_by("event_at", "seq").alias("last_event_at"),
        F.count("*").alias("n_events"),
    )


def run_events(events: DataFrame) -> DataFrame:
    """(seq, event_at, identity, service_date, event_type) that belong to a run: a repeated activation does not, a change of identity belongs to the new run."""
    columns = ["seq", "event_at", *KEY, "event_type"]
    if "revised_identity" in events.columns:
        return _attached(events, creations(events)).select(columns).dropDuplicates(["seq"])
    own = _marked(events).where(F.col("seq") >= F.col("created_seq"))
    return own.where(~_again()).select(columns).dropDuplicates(["seq"])


def skipped(events: DataFrame) -> DataFrame:
    """(event_type, n): messages without a run at their time."""
    if "revised_identity" in events.columns:
        marked = events.join(creations(events).drop("parent"), KEY, "left")
    else:
        marked = _marked(events)
    return marked.where(F.col("created_seq").isNull() | (F.col("seq") < F.col("created_seq"))).groupBy("event_type").agg(F.count("*").alias("n"))


def creations(events: DataFrame) -> DataFrame:
    """(service_date, identity, created_seq, parent): what creates each run first; ``parent`` is the identity it was changed from, if that was it.

    A changed run exists only if the old one did, so creations are found round by round along
    the chains: each round joins the changes to the runs known by then, and the rounds end
    when none is new or earlier, however long a chain is; creations only get earlier, so an
    end comes.
    """
    first = events.where(F.col("event_type").isin(*CREATES)).groupBy(*KEY).agg(F.min("seq").alias("created_seq"))
    known = first.select(*KEY, "created_seq", F.lit(None).cast(events.schema["identity"].dataType).alias("parent"))
    changes = _changes(events)
    done = False
    while not done:
        made = _following(changes, known).select(F.col("_to").alias("identity"), "service_date", F.col("_seq").alias("created_seq"), F.col("_from").alias("parent"))
        merged = known.unionByName(made).groupBy(*KEY).agg(F.min(F.struct("created_seq", "parent")).alias("b"))
        merged = kept(merged.select(*KEY, "b.created_seq", "b.parent"))
        done = merged.exceptAll(known).isEmpty()
        known = merged
    return known


def _changes(events: DataFrame) -> DataFrame:
    rows = events.where((F.col("event_type") == CHANGE) & F.col("revised_identity").isNotNull())
    return rows.select("service_date", F.col("identity").alias("_from"), F.col("revised_identity").alias("_to"), F.col("seq").alias("_seq"), F.col("event_at").alias("_at"))


def _following(changes: DataFrame, known: DataFrame) -> DataFrame:
    """The changes of runs that exist by then."""
    old = known.select("service_date", F.col("identity").alias("_from"), "created_seq")
    return changes.join(old, ["service_date", "_from"]).where(F.col("_seq") > F.col("created_seq"))


def roots(created: DataFrame) -> DataFrame:
    """(identity, service_date, root_identity) of each run: the one at the start of its chain; chains halve with each round."""
    at = kept(created.select(*KEY, F.coalesce("parent", "identity").alias("root_identity")))
    while True:
        on = at.select(F.col("identity").alias("root_identity"), "service_date", F.col("root_identity").alias("_next"))
        further = kept(at.join(on, ["root_identity", "service_date"]).select(*KEY, F.col("_next").alias("root_identity")))
        if further.exceptAll(at).isEmpty():
            return at
        at = further


def _attached(events: DataFrame, created: DataFrame) -> DataFrame:
    """The messages that belong to a run, with its ``created_seq``; those that change an identity come under the new one."""
    own = events.where(F.col("event_type") != CHANGE).join(created.drop("parent"), KEY).where((F.col("seq") >= F.col("created_seq")) & ~_again())
    moved = _following(_changes(events), created).select(F.col("_to").alias("identity"), "service_date", F.col("_seq").alias("seq"), F.col("_at").alias("event_at"), F.lit(CHANGE).alias("event_type"))
    moved = moved.join(created.drop("parent"), KEY)
    return own.unionByName(moved, allowMissingColumns=True)


def _with_changes(events: DataFrame) -> DataFrame:
    """``runs`` of events with changes of identity; also (superseded_by, root_identity)."""
    created = creations(events)
    attached = _attached(events, created)
    kind, begins = F.col("event_type"), F.col("seq") == F.col("created_seq")
    state = F.when(kind == "cancellation", "cancelled").when(kind == "reinstatement", "activated").when(begins, F.when(kind == "unidentified", "unidentified").otherwise("activated"))
    carried = [c for c in CARRIED if c in events.columns]
    told = [F.when(begins & (kind == "activation"), F.col(c)).alias(c) for c in (*carried, "train_uid")]
    rows = attached.select(*KEY, "seq", "event_at", "created_seq", state.alias("state"), F.lit(True).alias("own"), F.when(begins & (kind == "activation"), F.col("event_at")).alias("activated_at"), *told)
    left = _following(_changes(events), created).select(F.col("_from").alias("identity"), "service_date", F.col("_seq").alias("seq"), F.col("_at").alias("event_at"), "created_seq", F.lit("superseded").alias("state"), F.col("_to").alias("superseded_by"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    merged = rows.unionByName(left, allowMissingColumns=True).groupBy(*KEY).agg(
        *[F.min(c).alias(c) for c in (*carried, "train_uid", "activated_at")], last("state"), F.min("created_seq").alias("created_seq"),
        F.max_by("event_at", "seq").alias("last_event_at"), F.count("own").alias("n_events"), last("superseded_by"),
    )
    merged = kept(merged.join(roots(created), KEY))
    first = merged.select(F.col("identity").alias("root_identity"), "service_date", *[F.col(c).alias(f"_{c}") for c in carried])
    merged = merged.join(first, ["root_identity", "service_date"]).withColumns({c: F.col(f"_{c}") for c in carried})
    return merged.withColumn("run_id", _run_id()).drop(*[f"_{c}" for c in carried])


def with_identity_changes(events: DataFrame) -> DataFrame:
    """(service_date, identity, root_identity, superseded_by, created_seq) of runs that may change identity."""
    return _with_changes(events).select("service_date", "identity", "root_identity", "superseded_by", "created_seq")
