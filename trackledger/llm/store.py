"""Shared intermediate storage, and membership filters of fixed size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session on one machine (as in tests) may fall back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    global _LOCAL
    _LOCAL = _LOCAL or tempfile.mkdtemp(prefix="trackledger-")
    return _LOCAL


_LOCAL = ""


#: Rows per Arrow batch where rows are whole texts; Spark's default of 10,000 suits narrow rows.
ARROW_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch to ``ARROW_ROWS`` rows, unless it was set to less."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


@contextmanager
def small_messages(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs run within send Arrow batches of about so many bytes at most, however few rows that is."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as Parquet to the shared folder and read back: lineage ends here."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of a membership filter, 8 MB: fixed whatever the input.
FILTER_BITS = 26


class Membership:
    """A membership filter of fixed size over 64-bit hashes: false positives only.

    It only thins rows out before an exact join; with far more members than bits it
    lets everything through, and the result is the same.
    """

    def __init__(self, hashes: DataFrame, column: str):
        bit = F.shiftrightunsigned(column, 64 - FILTER_BITS)
        words = (
            hashes.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(`{column}`, {64 - FILTER_BITS}) & 63 as int))").alias("bits"))
            .groupBy("word")
            .agg(F.bit_or("bits").alias("bits"))
            .toArrow()
        )
        table = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
        table[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
        self.table = hashes.sparkSession.sparkContext.broadcast(table)


def may_hold(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """True for each hash that may be in the filter's table."""
    bit = hashes >> np.uint64(64 - FILTER_BITS)
    return (table[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def may_hold_column(held: Membership, hashes: Column) -> Column:
    table = held.table

    def check(at: pa.Array) -> pa.Array:
        return pa.array(may_hold(table.value, at.to_numpy(zero_copy_only=False).view(np.uint64)))

    return F.arrow_udf(check, "boolean")(hashes)
