"""Landing frames exactly once, and ingest statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trackledger.sources.frames import frame_summary, land

FRAMES = "feed_name string, body_hash string, n long, n_parsed long, n_unsupported long, n_malformed long, last_event_at timestamp, status string, batch long, day date"
SIGNS = "feed_name string, day date, word int, bits long, batch long"
#: Bits of a day's filter of a feed's hashes, and how many of them each hash sets.
DAY_BITS, DAY_MARKS = 1 << 22, 3


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return None
    return spark.read.schema(schema).parquet(path)


def _marks(rows: DataFrame) -> DataFrame:
    """The rows with the (word, bits) of each mark that their hash sets in a filter."""
    places = F.array(*[F.pmod(F.xxhash64(F.lit(k), "body_hash"), F.lit(DAY_BITS)) for k in range(DAY_MARKS)])
    marked = rows.withColumn("_at", F.explode(F.array_distinct(places)))
    return marked.withColumns({"word": F.shiftright("_at", 6).cast("int"), "bits": F.expr("shiftleft(1L, cast(_at & 63 as int))")}).drop("_at")


def day_signs(frames: DataFrame) -> DataFrame:
    """(feed_name, day, word, bits): a filter per feed and day of the hashes recorded on it, of fixed size."""
    return _marks(frames.select("feed_name", "day", "body_hash")).groupBy("feed_name", "day", "word").agg(F.bit_or("bits").alias("bits"))


def days_to_read(signs: DataFrame, frames: DataFrame) -> list:
    """The days on which one of the frames (feed_name, body_hash) may have been recorded; days of none are never missed."""
    wanted = _marks(frames.select("feed_name", "body_hash").distinct())
    need = wanted.groupBy("feed_name", "body_hash").agg(F.count("*").alias("need"))
    held = signs.join(wanted.select("feed_name", "word").distinct(), ["feed_name", "word"], "left_semi").groupBy("feed_name", "day", "word").agg(F.bit_or("bits").alias("held"))
    hits = wanted.join(held, ["feed_name", "word"]).where(F.col("held").bitwiseAND(F.col("bits")) != 0)
    hits = hits.groupBy("feed_name", "body_hash", "day").agg(F.count("*").alias("n")).join(need, ["feed_name", "body_hash"]).where("n = need")
    return [r["day"] for r in hits.select("day").distinct().collect()]  # a row per day at most


def land_batch(frames: DataFrame, batch_id: int, parser: Callable[[DataFrame], DataFrame], path: str) -> None:
    """Writes a batch's new frames and their children under its own id: a repeated batch replaces itself.

    Frames that earlier batches recorded are left out.  The record is a narrow table of
    hashes by day, with a filter of fixed size per day; only days whose filter may hold one
    of the batch's hashes are read, so a batch without redeliveries mostly reads none.
    """
    spark = frames.sparkSession
    hashed = frames.withColumn("body_hash", F.sha2(F.col("body").cast("binary"), 256))
    signs, recorded = _read(spark, f"{path}/signs", SIGNS), None
    if signs is not None:
        days = days_to_read(signs.where(F.col("batch") != batch_id), hashed)
        if days:
            recorded = _read(spark, f"{path}/frames", FRAMES).where(F.col("day").isin(days) & (F.col("batch") != batch_id))
    children = parser(land(frames, recorded)).withColumn("event_month", F.date_format("event_at", "yyyy_MM"))
    children.write.mode("overwrite").partitionBy("feed_name", "event_month").parquet(f"{path}/children/batch={batch_id}")
    written = spark.read.schema(children.schema).parquet(f"{path}/children/batch={batch_id}")  # a batch may have none
    received = written.groupBy("feed_name", "body_hash").agg(F.to_date(F.min("received_at")).alias("day"))
    summary = frame_summary(written).join(received, ["feed_name", "body_hash"])
    summary.write.mode("overwrite").partitionBy("day").parquet(f"{path}/frames/batch={batch_id}")
    day_signs(received).write.mode("overwrite").parquet(f"{path}/signs/batch={batch_id}")


def land_stream(frames: DataFrame, parser: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Lands a stream of frames; the checkpoint takes the place of acknowledging each one."""
    run = frames.writeStream.foreachBatch(lambda batch, batch_id: land_batch(batch, batch_id, parser, path))
    return run.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def without_redelivery(frames: DataFrame, keep: str | None = None) -> DataFrame:
    """The first delivery of each frame of a stream; ``keep`` bounds how long hashes are remembered."""
    if keep:
        return frames.withWatermark("received_at", keep).dropDuplicatesWithinWatermark(["feed_name", "body_hash"])
    return frames.dropDuplicates(["feed_name", "body_hash"])


def ingest_stats(frames: DataFrame, seconds: int = 30) -> DataFrame:
    """(feed_name, window_start, n, mean_ms, max_lag_s) per tumbling window of receipt, in batch or streaming."""
    lag = (F.unix_millis("received_at") - F.unix_millis("event_at")) / 1000
    grouped = frames.groupBy("feed_name", F.window("received_at", f"{seconds} seconds").alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.avg("processing_ms").alias("mean_ms"), F.max(lag).alias("max_lag_s")).select("feed_name", F.col("w.start").alias("window_start"), "n", "mean_ms", "max_lag_s")


def event_windows(events: DataFrame, seconds: int = 30) -> DataFrame:
    """(window_start, n, n_areas): messages and areas heard per tumbling window of event time."""
    grouped = events.groupBy(F.window(F.col("event_at").cast("timestamp"), f"{seconds} seconds").alias("w"))
    counted = grouped.agg(F.count("*").alias("n"), F.count_distinct("td_area").alias("n_areas"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", "n_areas")


def with_empty_windows(stats: DataFrame, seconds: int = 30) -> DataFrame:
    """The statistics with a row of 0 frames for every window in between that had none."""
    bounds = stats.groupBy("feed_name").agg(F.min("window_start").alias("a"), F.max("window_start").alias("b"))
    spine = bounds.select("feed_name", F.explode(F.expr(f"sequence(a, b, interval {seconds} seconds)")).alias("window_start"))
    return spine.join(stats, ["feed_name", "window_start"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
