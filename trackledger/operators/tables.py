"""Idempotent writes as plain set operations: deduplication, upserts, diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _key(columns: list[str]) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]


def insert_new(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows whose key does not exist yet, one per key; a null in a key counts as empty."""
    own = [f"_k{i}" for i in range(len(keys))]
    named = lambda df: [k.alias(n) for k, n in zip(_key(keys), own, strict=True)]
    firsts = new.select("*", *named(new)).dropDuplicates(own)
    return firsts.join(existing.select(*named(existing)).distinct(), own, "left_anti").select(*new.columns)


def insert_or_get(existing: DataFrame, new: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """(keys, id) of every new key: the id of the existing row, else the least one among the new rows; a null key counts as empty."""
    own = [f"_k{i}" for i in range(len(keys))]
    side = lambda df, n: df.select(*[k.alias(o) for k, o in zip(_key(keys), own, strict=True)], *keys, F.struct(F.lit(n).alias("_new"), F.col(id_column)).alias("_r"))
    both = side(existing, 0).unionByName(side(new, 1))
    least = both.groupBy(*own).agg(F.max("_r._new").alias("_new"), *[F.min_by(k, "_r").alias(k) for k in keys], F.min("_r").alias("_r"))
    return least.where("_new = 1").select(*keys, F.col(f"_r.{id_column}").alias(id_column))


def last_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by ``order``; a null in a key counts as empty.

    A partial aggregate: a hot key is combined before the shuffle.
    """
    whole = F.max_by(F.struct(*rows.columns), F.col(order)).alias("_r")
    return rows.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(_key(keys))]).agg(whole).select("_r.*")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Existing rows replaced by the last new row of their key, and rows of new keys."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    whole = F.max_by(F.struct(*existing.columns), F.struct("_new", order)).alias("_r")
    return both.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(_key(keys))]).agg(whole).select("_r.*")


def merged_log(state: DataFrame | None, operations: DataFrame, keys: list[str], order: str, operation: str = "operation") -> DataFrame:
    """The last operation of each key by sequence, deletes included: a delete stays as a tombstone.

    ``state`` is what an earlier call gave.  A late operation that is older than what the
    state holds of its key changes nothing, so an old create does not bring back what a
    newer delete removed, in whatever order batches come.  ``visible`` leaves tombstones out.
    """
    both = operations if state is None else state.unionByName(operations)
    return last_per_key(both, keys, order)


def visible(state: DataFrame, operation: str = "operation") -> DataFrame:
    """The rows of keys whose last operation is not a delete."""
    return state.where(F.col(operation) != "delete")


def diagnostics(events: DataFrame, wanted: DataFrame, key: list[str], at: str) -> DataFrame:
    """(key, n, first_at, last_at) of each wanted key; one without events has n = 0 and no times."""
    found = events.join(wanted, key, "left_semi").groupBy(*key).agg(F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    return wanted.join(found, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def replace_children(existing: DataFrame, staged: DataFrame, touched: DataFrame, parent: str) -> DataFrame:
    """Children of touched parents come from the staged rows alone, all others stay."""
    kept = existing.join(touched.select(parent).distinct(), parent, "left_anti")
    return kept.unionByName(staged.join(touched.select(parent).distinct(), parent, "left_semi"))


def duplicate_keys(rows: DataFrame, keys: list[str], allowed: str | None = None) -> DataFrame:
    """(keys, n): keys of several rows, unless one of them allows it."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.bool_or(F.col(allowed) if allowed else F.lit(False)).alias("_a"))
    return counted.where((F.col("n") > 1) & ~F.coalesce("_a", F.lit(False))).drop("_a")


def diff(left: DataFrame, right: DataFrame, key: str | list[str]) -> DataFrame:
    """(key, change): added, removed or modified rows between two snapshots; rows that share a key are compared together."""
    keys = [key] if isinstance(key, str) else key

    def packed(df: DataFrame, name: str) -> DataFrame:
        row = F.to_json(F.struct(*sorted(c for c in df.columns if c not in keys)), {"ignoreNullFields": "false"})
        return df.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias(name))

    both = packed(left, "_l").join(packed(right, "_r"), keys, "full_outer")
    change = F.when(F.col("_l").isNull(), "added").when(F.col("_r").isNull(), "removed").when(F.col("_l") != F.col("_r"), "modified")
    return both.select(*keys, change.alias("change")).where(F.col("change").isNotNull())


def reconcile(recorded: DataFrame, stored: DataFrame, key: str = "object_key", digest: str = "sha256") -> DataFrame:
    """(key, state): ok, missing, corrupt or orphan, from the record and what the store holds."""
    a = recorded.select(F.col(key), F.col(digest).alias("_want"), F.lit(True).alias("_rec"))
    b = stored.select(F.col(key), F.col(digest).alias("_have"), F.lit(True).alias("_sto"))
    both = a.join(b, key, "full_outer")
    state = F.when(F.col("_sto").isNull(), "missing").when(F.col("_rec").isNull(), "orphan").when(~F.col("_want").eqNullSafe(F.col("_have")), "corrupt").otherwise("ok")
    return both.select(key, state.alias("state"))


def sequenced(rows: DataFrame, partition: str, order: list[str], start: Column) -> DataFrame:
    """``sequence``: dense numbers per feed from ``start``, in a total order."""
    return rows.withColumn("sequence", start + F.row_number().over(Window.partitionBy(partition).orderBy(*order)))


