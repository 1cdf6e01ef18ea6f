"""Proportional stratified interleaving into shards.

Rows are shuffled by a seeded hash and ranked within their source; the row of rank r
among n gets the fractional rank ``(r - 1/2) / n``.  Sorted by it, the sources run side by
side at their own pace, so any stretch of the order has the mixture of the whole.  The
order is cut into stretches of equal numbers of rows, one per shard: law ``rows``, counts
differ by one at most.

No rank is taken in one task.  A source is ranked in ``BUCKETS`` ranges of the hash, and
the global order in as many ranges of the fractional rank: rows are numbered within a
range, and the ranges start where the counts of those before end.  A source with a third
of all rows is spread over all its ranges.

Texts are read once; what is shuffled is a narrow row per document, written to the shared
folder between the two rankings.  Null texts have 0 bytes and checksum 0, a null source
is a source like any other, null and repeated ids are rows like any other, and rows that
are equal in everything may take each other's place.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackledger.llm.store import written

BUCKETS = 2048
#: Added to the bytes of each text: the size of its length prefix in a shard.
OVERHEAD = 8


def _numbered(rows: DataFrame, group: list[str], bucket: str, order: list, name: str) -> DataFrame:
    """``name``: the number of each row, from 0, within its group by bucket, then ``order``."""
    counts = rows.groupBy(*group, bucket).agg(F.count("*").alias("_in"))
    before = Window.partitionBy(*group) if group else Window.partitionBy()
    before = before.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"_{c}") for c in (*group, bucket)], F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(*group, bucket).orderBy(*order)) - 1
    same = [rows[c].eqNullSafe(starts[f"_{c}"]) for c in (*group, bucket)]
    found = rows.withColumn("_place", place).join(starts, same)
    return found.withColumn(name, F.col("_start") + F.col("_place")).drop("_start", "_place", *[f"_{c}" for c in (*group, bucket)])


def interleave(
    docs: DataFrame, shards: int, seed: int = 17, id_column: str = "doc_id", text: str = "text", source: str = "source", buckets: int = BUCKETS
) -> DataFrame:
    """(id, source, size, text_crc32, shard, slot) of each row; slots of a shard run from 0 without a gap."""
    raw: Column = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_column).alias("id"), F.col(source).alias("source"), (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("crc")
    ).withColumn("shuffled", F.xxhash64(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")), "crc"))
    rows = rows.withColumn("range", F.pmod(F.shiftrightunsigned("shuffled", 20), F.lit(buckets)).cast("int"))
    rows = written(rows, "shard-rows")
    order = ["shuffled", "id", "crc", "size"]
    ranked = _numbered(rows, ["source"], "range", order, "rank")
    sizes = rows.groupBy(F.col("source").alias("_source")).agg(F.count("*").alias("_n"))
    ranked = ranked.join(sizes, ranked["source"].eqNullSafe(sizes["_source"])).drop("_source")
    ranked = ranked.withColumn("fraction", (F.col("rank") + 0.5) / F.col("_n"))
    ranked = ranked.withColumn("range", F.least(F.floor(F.col("fraction") * buckets), F.lit(buckets - 1)).cast("int"))
    ranked = written(ranked.drop("_n", "rank"), "shard-ranks")
    ordered = _numbered(ranked, [], "range", ["fraction", "source", *order], "position")
    ordered = ordered.withColumn("total", F.lit(ranked.count()))
    # the shard of a position p is the last s with floor(s * total / shards) <= p
    ordered = ordered.withColumn("shard", F.expr(f"cast(((position + 1) * {shards} - 1) div total as int)"))
    first = F.expr(f"(shard * total) div {shards}")
    return ordered.select(F.col("id").alias(id_column), "source", "size", F.col("crc").alias("text_crc32"), "shard", (F.col("position") - first).cast("long").alias("slot"))
