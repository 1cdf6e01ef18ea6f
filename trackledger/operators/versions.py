"""Projections that are rebuilt in place: versioned folders and a manifest that switches in one step.

A version is a folder of its own below the projection's path.  The manifest is a row of
small numbered files; each names a folder and is made by creating a file that must not
exist yet, which a shared file system grants to one writer only.  Readers take the highest
number, so they see a version whole or not at all, and a build that fails leaves no trace
but an unnamed folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Overtaken(Exception):
    """Another writer published the next version first."""


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest")
    return jvm, folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def version(spark: SparkSession, path: str) -> int:
    """The number of the current version; 0 if there is none."""
    _, folder, files = _files(spark, path)
    if not files.exists(folder):
        return 0
    return max((int(s.getPath().getName()) for s in files.listStatus(folder) if s.getPath().getName().isdigit()), default=0)


def folder_of(spark: SparkSession, path: str, number: int) -> str:
    jvm, folder, files = _files(spark, path)
    stream = files.open(jvm.org.apache.hadoop.fs.Path(folder, str(number)))
    try:
        return f"{path}/{jvm.org.apache.commons.io.IOUtils.toString(stream, 'UTF-8').strip()}"
    finally:
        stream.close()


def current(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The rows of the current version."""
    number = version(spark, path)
    if not number:
        raise FileNotFoundError(f"{path} has no version")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(folder_of(spark, path, number))


def publish(rows: DataFrame, path: str, expected: int | None = None) -> int:
    """Writes the rows as the next version and switches to it; ``expected`` is the version that they were made from.

    Raises ``Overtaken`` if another writer has published that version's successor meanwhile.
    """
    spark = rows.sparkSession
    number = (version(spark, path) if expected is None else expected) + 1
    name = f"v{number}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{name}")
    jvm, folder, files = _files(spark, path)
    try:
        stream = files.create(jvm.org.apache.hadoop.fs.Path(folder, str(number)), False)
    except Exception as error:
        if "AlreadyExists" in str(error) or "already exists" in str(error):
            raise Overtaken(f"version {number} of {path} is there already") from error
        raise
    try:
        stream.write(bytearray(name.encode()))
    finally:
        stream.close()
    return number


def rebuild(spark: SparkSession, path: str, build: Callable[[], DataFrame], audit: str | None = None, link: str = "row_id") -> int:
    """Builds a projection anew and switches to it; audit rows at ``audit`` stay, their links to the old rows are nulled.

    Until the switch readers go on with the old version.
    """
    before = version(spark, path)
    number = publish(build(), path, before)
    if audit and version(spark, audit):
        rows = current(spark, audit)
        publish(rows.withColumn(link, F.lit(None).cast(rows.schema[link].dataType)), audit)
    return number


def discard_old(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Removes the folders of all versions but the last ones, and gives their names; unnamed folders stay."""
    jvm, folder, files = _files(spark, path)
    gone = []
    for number in range(1, version(spark, path) - keep + 1):
        at = jvm.org.apache.hadoop.fs.Path(folder_of(spark, path, number))
        if files.exists(at) and files.delete(at, True):
            gone.append(at.getName())
    return gone
