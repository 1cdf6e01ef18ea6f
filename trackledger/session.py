"""Session settings that every job of this library expects."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(name: str = "trackledger", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | settings).getOrCreate()


_LOCAL = ""


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    A session on one machine that has none set (as in tests) gets a temporary one.
    """
    global _LOCAL
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    _LOCAL = _LOCAL or ("" if folder else tempfile.mkdtemp(prefix="trackledger-"))
    return folder or _LOCAL


def kept(rows: DataFrame) -> DataFrame:
    """The rows, checkpointed in the shared folder: lineage ends here."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint()


def stored(rows: DataFrame) -> DataFrame:
    """The rows, written in the shared folder and read again: their size is known then, so what a small table is joined to is not shuffled."""
    path = f"{shared_folder(rows.sparkSession)}/stored-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
