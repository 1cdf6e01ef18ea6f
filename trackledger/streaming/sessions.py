"""A log of the sessions in which streams were connected."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

ENTRIES = "session string, name string, event string, at timestamp, error string"


class SessionLog(StreamingQueryListener):
    """Writes a line when a stream starts and one when it ends; each is a small file of its own in a shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.names: dict[str, str | None] = {}

    def _write(self, session: str, event: str, error: str | None = None) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{uuid.uuid4().hex}.json")
        entry = {"session": session, "name": self.names.get(session), "event": event, "at": datetime.now(timezone.utc).isoformat(), "error": error}
        out = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(at, False)
        try:
            out.write(bytearray(json.dumps(entry).encode()))
        finally:
            out.close()

    def onQueryStarted(self, event) -> None:
        self.names[str(event.runId)] = event.name
        self._write(str(event.runId), "opened")

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._write(str(event.runId), "closed", event.exception[:2000] if event.exception else None)


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """(session, name, opened_at, closed_at, error) of each session; one that is open, or was cut off, has no end."""
    entries = spark.read.schema(ENTRIES).json(path)
    at = lambda event: F.max(F.when(F.col("event") == event, F.col("at")))
    return entries.groupBy("session").agg(F.max("name").alias("name"), at("opened").alias("opened_at"), at("closed").alias("closed_at"), F.max("error").alias("error"))
