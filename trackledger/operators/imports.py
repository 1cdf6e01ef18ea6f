"""Imports and repairs that may run again without doing harm."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMPORTS = "source_kind string, checksum string, status string, summary string"


def start_import(imports: DataFrame, kind: str, checksum: str, spark: SparkSession) -> tuple[DataFrame, bool]:
    """(imports, needed): a file that was imported completely is not imported again; others start or start anew."""
    own = (F.col("source_kind") == kind) & (F.col("checksum") == checksum)
    known = imports.where(own).select("status").collect()
    if any(r.status == "completed" for r in known):
        return imports, False
    return imports.where(~own).unionByName(spark.createDataFrame([(kind, checksum, "running", None)], IMPORTS)), True


def end_import(imports: DataFrame, kind: str, checksum: str, error: str | None = None) -> DataFrame:
    """The import as completed, or as failed with the start of its error."""
    own = (F.col("source_kind") == kind) & (F.col("checksum") == checksum)
    status, summary = ("failed", error[:2000]) if error else ("completed", None)
    return imports.withColumns({"status": F.when(own, status).otherwise(F.col("status")), "summary": F.when(own, F.lit(summary)).otherwise(F.col("summary"))})


def import_decisions(attempts: DataFrame) -> DataFrame:
    """(source_kind, checksum, seq, decision) of attempts (source_kind, checksum, seq, ok) to import a file, in order of ``seq``.

    A file that was imported completely is ``skipped`` from then on; until then each attempt is ``completed`` or ``failed``.
    """
    key = ["source_kind", "checksum"]
    first = attempts.where("ok").groupBy(*key).agg(F.min("seq").alias("_done"))
    decision = F.when(F.col("seq") > F.col("_done"), "skipped").when(F.col("ok"), "completed").otherwise("failed")
    return attempts.join(first, key, "left").select(*key, "seq", decision.alias("decision"))


def accepted_saves(attempts: DataFrame) -> DataFrame:
    """(slug, seq, base_revision, accepted, revision) of attempts (slug, seq, base_revision) to save drafts, in order of ``seq``.

    A save is accepted if it was made from the last revision, and becomes the next one; a
    new draft is at revision 0.  Each slug goes through one task in order, holding a number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, revision = object(), 0
        for batch in batches:
            accepted, revisions = [], []
            for slug, base in zip(batch.column("slug").to_pylist(), batch.column("base_revision").to_pylist(), strict=True):
                if slug != now:
                    now, revision = slug, 0
                accepted.append(base == revision)
                revision += base == revision
                revisions.append(revision)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(accepted), pa.array(revisions, pa.int64())], ["slug", "seq", "base_revision", "accepted", "revision"])

    rows = attempts.select("slug", F.col("seq").cast("long").alias("seq"), F.col("base_revision").cast("long").alias("base_revision"))
    return rows.repartition("slug").sortWithinPartitions("slug", "seq").mapInArrow(run, "slug string, seq long, base_revision long, accepted boolean, revision long")


def lineage(children: DataFrame, recorded: DataFrame, archive: DataFrame) -> DataFrame:
    """Every child with the frame that it came in and the archived original of that frame: (…, batch, day, object_key).

    ``recorded``: (feed_name, body_hash, batch, day); ``archive``: (sha256, object_key).  A
    child whose original is not archived has no object_key.
    """
    frames = recorded.select("feed_name", "body_hash", "batch", "day")
    return children.join(frames, ["feed_name", "body_hash"]).join(archive.select(F.col("sha256").alias("body_hash"), "object_key"), "body_hash", "left")


def staged_children(staged: DataFrame, parents: DataFrame, key: list[str], parent: str) -> DataFrame:
    """Staged child rows under the id of the parent that was written for their natural key."""
    return staged.drop(parent).join(parents.select(*key, parent), key).drop(*key)


def reparsed(children: DataFrame, again: DataFrame) -> DataFrame:
    """(body_hash, child_index, old and new status and type) of the children that parse differently now."""
    key = ["feed_name", "body_hash", "child_index"]
    old = children.select(*key, F.col("parse_status").alias("old_status"), F.col("event_type").alias("old_type"))
    new = again.select(*key, F.col("parse_status").alias("new_status"), F.col("event_type").alias("new_type"))
    both = old.join(new.hint("merge"), key)  # both are as large as the log, whatever their estimates say
    return both.where((F.col("old_status") != F.col("new_status")) | (F.col("old_type") != F.col("new_type")))


def replaced(children: DataFrame, again: DataFrame, changed: DataFrame) -> DataFrame:
    """The children with the changed ones as they parse now."""
    key = ["feed_name", "body_hash", "child_index"]
    kept = children.join(changed.select(*key), key, "left_anti")
    return kept.unionByName(again.join(changed.select(*key), key, "left_semi"))


def backfilled(index: DataFrame, bindings: DataFrame) -> DataFrame:
    """The binding index with the bindings of map versions that have none in it."""
    missing = bindings.join(index.select("map_id").distinct(), "map_id", "left_anti")
    return index.unionByName(missing.select(*index.columns))


class Conflict(Exception):
    """Someone else saved the draft first."""


def save_draft(drafts: DataFrame, slug: str, revision: int, document: str, spark: SparkSession) -> DataFrame:
    """(slug, revision, document) with the next revision, if the given one is still the last."""
    last = drafts.where(F.col("slug") == slug).agg(F.max("revision")).first()[0] or 0
    if last != revision:
        raise Conflict(f"{slug} is at revision {last}, not {revision}")
    return drafts.unionByName(spark.createDataFrame([(slug, revision + 1, document)], drafts.schema))
