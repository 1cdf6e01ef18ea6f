"""Long histories of berths on disk: stretches of the log, and narrow edges between them.

``store`` writes the touches of a log by stretches of sequence numbers, and for each stretch
the first and last touch of each berth and the span of its times.  A question about some
days reads the stretches whose span meets them, and for what reaches over their ends the
edges only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackledger.operators.berths import KEY, touches

TOUCHES = "seq long, event_at timestamp, td_area string, message_type string, descr string, berth string, half string, opens boolean, reason string, checked boolean, stretch long"
EDGES = "td_area string, berth string, stretch long, first struct<event_at:timestamp,seq:long,reason:string>, since timestamp, until timestamp"


def store(events: DataFrame, path: str, size: int) -> None:
    """Writes the touches of a log, ``size`` sequence numbers a stretch."""
    rows = touches(events).withColumn("stretch", F.floor(F.col("seq") / size)).withColumn("event_at", F.col("event_at").cast("timestamp"))
    rows.repartition("stretch").sortWithinPartitions("stretch", *KEY, "seq").write.partitionBy("stretch").parquet(f"{path}/touches")
    kept = rows.sparkSession.read.schema(TOUCHES).parquet(f"{path}/touches")
    first = F.min_by(F.struct("event_at", "seq", "reason"), "seq").alias("first")
    kept.groupBy(*KEY, "stretch").agg(first, F.min("event_at").alias("since"), F.max("event_at").alias("until")).write.parquet(f"{path}/edges")


def occupancies_between(spark: SparkSession, path: str, start: Column, end: Column, td_area: str | None = None) -> DataFrame:
    """(occupancy_id, td_area, berth, descr, entered_at, left_at, exit_seq, exit_reason) of those entered from ``start`` on and before ``end``."""
    edges = spark.read.schema(EDGES).parquet(f"{path}/edges")
    if td_area is not None:
        edges = edges.where(F.col("td_area") == td_area)
    spans = edges.groupBy("stretch").agg(F.min("since").alias("since"), F.max("until").alias("until"))
    wanted = [r["stretch"] for r in spans.where((F.col("until") >= start) & (F.col("since") < end)).select("stretch").collect()]  # a row per stretch
    rows = spark.read.schema(TOUCHES).parquet(f"{path}/touches").where(F.col("stretch").isin(wanted))
    if td_area is not None:
        rows = rows.where(F.col("td_area") == td_area)
    within = Window.partitionBy(*KEY, "stretch").orderBy("seq")
    rows = rows.withColumn("_next", F.lead(F.struct("event_at", "seq", "reason")).over(within))
    along = Window.partitionBy(*KEY).orderBy("stretch")
    over = edges.select(*KEY, "stretch", F.lead("first").over(along).alias("_over"))
    rows = rows.where(F.col("opens") & (F.col("event_at") >= start) & (F.col("event_at") < end)).join(over, [*KEY, "stretch"], "left")
    left = F.coalesce("_next", "_over")
    return rows.select(F.col("seq").alias("occupancy_id"), *KEY, "descr", F.col("event_at").alias("entered_at"), left["event_at"].alias("left_at"), left["seq"].alias("exit_seq"), left["reason"].alias("exit_reason"))
