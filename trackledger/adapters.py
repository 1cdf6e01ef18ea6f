"""Views of the generic test tables in the shapes of the operational feeds.

Each view is deterministic arithmetic over one table, so that the SQL in ``plans`` can
state the same view for comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schedules of the test tables lie in 1995-2001, their events in 2024.
SCHEDULE_SHIFT_DAYS = 9000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _four(n: Column) -> Column:
    return F.lpad(n.cast("string"), 4, "0")


def headcode(user: Column) -> Column:
    letter = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (user % 3 + 1).cast("int"))
    return F.concat((user % 5 + 1).cast("string"), letter, F.lit("0"), (user % 2).cast("string"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def td_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, event_at, td_area, message_type, from_berth, to_berth, descr) in the order of arrival."""
    kinds = F.create_map(*[F.lit(x) for x in ("click", "CA", "signup", "CA", "view", "CC", "purchase", "CB", "error", "CT")])
    return _events(spark, sf_dir).select(
        (F.col("event_id") + 1).alias("seq"),
        F.col("ts").alias("event_at"),
        F.concat(F.lit("A"), (F.col("user_id") % 5).cast("string")).alias("td_area"),
        kinds[F.col("event_type")].alias("message_type"),
        _four(F.col("k") % 12).alias("from_berth"),
        _four((F.col("k") + 1 + F.col("event_id") % 3) % 12).alias("to_berth"),
        F.when(F.col("event_id") % 17 == 0, "----").otherwise(headcode(F.col("user_id"))).alias("descr"),
    )


def td_s_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, event_at, td_area, address, data): signalling bytes."""
    return (
        _events(spark, sf_dir)
        .where(F.col("event_type") == "error")
        .select(
            (F.col("event_id") + 1).alias("seq"),
            F.col("ts").alias("event_at"),
            F.concat(F.lit("A"), (F.col("user_id") % 5).cast("string")).alias("td_area"),
            F.concat(F.lit("A"), (F.col("k") % 8).cast("string")).alias("address"),
            F.hex(F.col("k").cast("long")).alias("data"),
        )
    )


def trust_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, event_at, identity, event_type, service_date, signalling_id, train_uid)."""
    kinds = F.create_map(*[F.lit(x) for x in ("signup", "activation", "error", "cancellation", "purchase", "reinstatement", "view", "movement", "click", "movement")])
    return _events(spark, sf_dir).select(
        (F.col("event_id") + 1).alias("seq"),
        F.col("ts").alias("event_at"),
        F.col("user_id").alias("identity"),
        F.when((F.col("event_type") == "view") & (F.col("k") % 6 == 0), "unidentified").otherwise(kinds[F.col("event_type")]).alias("event_type"),
        F.to_date(F.col("ts") - F.expr("INTERVAL 3 HOURS")).alias("service_date"),
        headcode(F.col("user_id")).alias("signalling_id"),
        F.concat(F.lit("U"), (F.col("user_id") % 200).cast("string")).alias("train_uid"),
        F.col("value"),
        F.col("k"),
    )


def schedules(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """(schedule_id, train_uid, start_date, end_date, stp, days_run)."""
    key = F.col("o_orderkey")
    bits = F.concat(*[F.shiftright(key, i).bitwiseAND(F.lit(1)).cast("string") for i in range(7)])
    stp = F.element_at(F.array(*[F.lit(x) for x in "PNOC"]), (key % 4 + 1).cast("int"))
    start = F.date_add(F.to_date("o_orderdate"), shift)
    return table(spark, sf_dir, "orders").select(
        key.alias("schedule_id"),
        F.concat(F.lit("U"), (F.col("o_custkey") % 200).cast("string")).alias("train_uid"),
        start.alias("start_date"),
        F.date_add(start, (F.lit(30) + key % 60).cast("int")).alias("end_date"),
        stp.alias("stp"),
        F.when(key % 5 != 0, bits).alias("days_run"),
    )


def schedule_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(schedule_id, seq_no, tiploc)."""
    order = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice"
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("schedule_id"),
        F.expr(f"row_number() over (partition by l_orderkey order by {order})").alias("seq_no"),
        F.concat(F.lit("L"), F.col("l_suppkey").cast("string")).alias("tiploc"),
    )


def location_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tiploc, stanox, name)."""
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("L"), F.col("s_suppkey").cast("string")).alias("tiploc"),
        F.concat(F.lit("S"), F.col("s_nationkey").cast("string")).alias("stanox"),
        F.col("s_name").alias("name"),
    )


def smart_steps(spark: SparkSession) -> DataFrame:
    """(td_area, to_berth, stanox): 5 areas of 12 berths."""
    cell = F.col("id")
    return spark.range(60).select(
        F.concat(F.lit("A"), F.floor(cell / 12).cast("string")).alias("td_area"),
        _four(cell % 12).alias("to_berth"),
        F.concat(F.lit("S"), (cell % 25).cast("string")).alias("stanox"),
    )


def map_bindings(spark: SparkSession) -> DataFrame:
    """(slug, element_id, td_area, berth): two maps over some of the berths, with an area that sends nothing."""
    cell = F.col("id")
    area, berth = F.concat(F.lit("A"), F.floor(cell / 12).cast("string")), _four(cell % 12)
    rows = spark.range(72).select(F.when(cell % 2 == 0, "north").otherwise("south").alias("slug"), F.concat(F.lit("e-"), area, F.lit("-"), berth).alias("element_id"), area.alias("td_area"), berth.alias("berth"))
    return rows.where(F.col("berth") <= "0008")
