"""Which schedule of a train applies on a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackledger.session import kept

# Short-term-planning indicators by precedence, the highest first.
PRECEDENCE = ("C", "O", "N", "P")


def rank(stp: Column) -> Column:
    out = F.lit(0)
    for n, code in enumerate(reversed(PRECEDENCE), 1):
        out = F.when(stp == code, n).otherwise(out)
    return out


def runs_on(day: Column, start: Column, end: Column, days_run: Column) -> Column:
    """The date is in range and its weekday (Monday first) is set; no mask runs every day."""
    mask = F.coalesce(days_run, F.lit(""))
    return day.between(start, end) & ((mask == "") | (F.substr(mask, F.weekday(day) + 1, F.lit(1)) == "1"))


def by_month(rows: DataFrame, day: str) -> DataFrame:
    """The rows with the month of a date, to be joined with ``by_months``."""
    return rows.withColumn("_month", F.trunc(day, "month"))


def by_months(schedules: DataFrame) -> DataFrame:
    """A row per month that a schedule's dates touch, so that a join on train and month meets no schedule of other months."""
    months = F.sequence(F.trunc("start_date", "month"), F.trunc("end_date", "month"), F.expr("INTERVAL 1 MONTH"))
    return schedules.where(F.col("start_date") <= F.col("end_date")).withColumn("_month", F.explode(months))


def effective(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, outcome, schedule_id, stp, n_top): the one candidate of highest precedence, or ``ambiguous`` if several tie.

    Candidates already run on the date.  A cancellation that wins is returned as matched.
    Two aggregates with map-side combination, no sort: best rank, then its candidates.
    """
    best = candidates.withColumn("_rank", rank(F.col("stp"))).groupBy(*keys, "_rank").agg(F.count("*").alias("n_top"), F.min("schedule_id").alias("schedule_id"), F.min("stp").alias("stp"))
    top = best.groupBy(*keys).agg(F.max_by(F.struct("n_top", "schedule_id", "stp"), "_rank").alias("b"))
    one = F.col("b.n_top") == 1
    return top.select(*keys, F.when(one, "matched").otherwise("ambiguous").alias("outcome"), F.when(one, F.col("b.schedule_id")).alias("schedule_id"), F.when(one, F.col("b.stp")).alias("stp"), F.col("b.n_top").alias("n_top"))


def effective_on(schedules: DataFrame, day: str) -> DataFrame:
    """The effective schedule of every train that has one on a date."""
    at = F.to_date(F.lit(day))
    return effective(schedules.where(runs_on(at, F.col("start_date"), F.col("end_date"), F.col("days_run"))), ["train_uid"])


def lookup(schedules: DataFrame, wanted: DataFrame) -> DataFrame:
    """(train_uid, day, outcome, schedule_id): matched, ambiguous, unmatched, or not_found for a train without any schedule."""
    runs = by_month(wanted, "day").join(by_months(schedules), ["train_uid", "_month"]).where(runs_on(F.col("day"), F.col("start_date"), F.col("end_date"), F.col("days_run")))
    found = effective(runs, ["train_uid", "day"])
    known = schedules.select("train_uid").distinct().withColumn("_known", F.lit(True))
    out = wanted.join(found, ["train_uid", "day"], "left").join(known, "train_uid", "left")
    none = F.when(F.col("_known"), "unmatched").otherwise("not_found")
    return out.select("train_uid", "day", F.coalesce("outcome", none).alias("outcome"), "schedule_id")


def link_runs(runs: DataFrame, schedules: DataFrame) -> DataFrame:
    """(run_id, outcome, schedule_id): every run with the outcome of its train's lookup on its service date.

    Runs of one train and date have one outcome, so schedules meet trains and dates, not runs.
    Of the schedules, only months in which there are runs are shuffled.
    """
    key = ["train_uid", "service_date"]
    own = runs.select("run_id", *key)
    days = kept(by_month(own.select(*key).distinct(), "service_date"))
    months = F.broadcast(days.select("_month").distinct())  # a row per month
    cand = days.join(by_months(schedules).join(months, "_month", "left_semi"), ["train_uid", "_month"])
    cand = cand.where(runs_on(F.col("service_date"), F.col("start_date"), F.col("end_date"), F.col("days_run")))
    found = effective(cand, key).select(*key, "outcome", "schedule_id")
    return own.join(found, key, "left").select("run_id", F.coalesce("outcome", F.lit("unmatched")).alias("outcome"), "schedule_id")


def versions(operations: DataFrame) -> DataFrame:
    """Schedules after a log of create, overwrite, update and delete by natural key: the last operation wins, deletes remove."""
    key = ["train_uid", "start_date", "end_date", "stp"]
    last = Window.partitionBy(*key).orderBy(F.col("seq").desc())
    rows = operations.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return rows.where(F.col("operation") != "delete")
