"""Stretches of a keyed history that are parted by gaps, and histories in bounded segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(left: DataFrame, right: DataFrame, columns: dict[str, str]) -> Column:
    found = F.lit(True)
    for a, b in columns.items():
        found = found & left[a].eqNullSafe(right[b])
    return found


def with_pieces(rows: DataFrame, key: list[str], at: str, gap_seconds: int, bucket_seconds: int = 3600, name: str = "piece") -> DataFrame:
    """Adds ``name``: the number, from 1, of the stretch of its key without a gap of more than ``gap_seconds`` that a row is in.

    A key's history is never brought together: rows are numbered within buckets of time, and
    a second pass over one narrow row per key and bucket tells which of them go on in the
    next and how many stretches came before.  ``at`` is a timestamp; rows without one form a
    stretch of their own, number 0.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    rows = rows.withColumn("_m", micros).withColumn("_b", F.floor(F.col("_m") / (bucket_seconds * 1_000_000)))
    order = Window.partitionBy(*key, "_b").orderBy("_m")
    opens = F.coalesce(F.col("_m") - F.lag("_m").over(order) > gap_seconds * 1_000_000, F.lit(True))
    rows = rows.withColumn("_opens", opens).withColumn("_local", F.sum(F.col("_opens").cast("int")).over(order))
    edges = rows.where("_m is not null").groupBy(*key, "_b").agg(F.min("_m").alias("_first"), F.max("_m").alias("_last"), F.max("_local").alias("_n"))
    along = Window.partitionBy(*key).orderBy("_b")
    edges = edges.withColumn("_on", F.coalesce((F.col("_first") - F.lag("_last").over(along) <= gap_seconds * 1_000_000).cast("int"), F.lit(0)))
    before = F.coalesce(F.sum(F.col("_n") - F.col("_on")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = edges.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("_b").alias("_bucket"), (before - F.col("_on")).alias("_base"))
    found = rows.join(edges, _same(rows, edges, {**{k: f"_{k}" for k in key}, "_b": "_bucket"}), "left")
    return found.withColumn(name, F.coalesce(F.col("_base") + F.col("_local"), F.lit(0))).drop("_m", "_b", "_opens", "_local", "_base", "_bucket", *[f"_{k}" for k in key])


def with_neighbours(rows: DataFrame, key: list[str], order: str, ahead: Column, back: Column, size: int, names: tuple[str, str] = ("before", "following")) -> DataFrame:
    """Adds ``back`` of the row before and ``ahead`` of the row after, in a key's order, without bringing the key together.

    ``order`` is a whole number without ties in a key.  Rows are put into segments of ``size``
    numbers; ``lag`` and ``lead`` run within a segment, and what lies over its edges comes
    from one narrow row per key and segment, whose neighbours are found in a second pass.
    Values may be null: a neighbour is told from none by being there.
    """
    here, there = names
    rows = rows.withColumn("_s", F.floor(F.col(order) / size)).withColumns({"_back": F.struct(back.alias("v")), "_ahead": F.struct(ahead.alias("v"))})
    within = Window.partitionBy(*key, "_s").orderBy(order)
    rows = rows.withColumns({"_p": F.lag("_back").over(within), "_f": F.lead("_ahead").over(within)})
    edges = rows.groupBy(*key, "_s").agg(F.min_by("_ahead", order).alias("_first"), F.max_by("_back", order).alias("_last"))
    along = Window.partitionBy(*key).orderBy("_s")
    edges = edges.select(*[F.col(k).alias(f"_k_{k}") for k in key], F.col("_s").alias("_segment"), F.lag("_last").over(along).alias("_over_p"), F.lead("_first").over(along).alias("_over_f"))
    found = rows.join(edges, _same(rows, edges, {**{k: f"_k_{k}" for k in key}, "_s": "_segment"}), "left")
    found = found.withColumns({here: F.coalesce("_p", "_over_p")["v"], there: F.coalesce("_f", "_over_f")["v"]})
    return found.drop("_s", "_back", "_ahead", "_p", "_f", "_segment", "_over_p", "_over_f", *[f"_k_{k}" for k in key])
