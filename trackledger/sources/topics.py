"""Message topics and fixture replays as data sources of Spark streams.

``topic``: a folder per topic.  The writer puts each batch into numbered files, which are
there whole or not at all; a batch that is written again replaces its own files.  The reader
goes through the files in order and resumes at its checkpoint.  A line that is not a JSON
object is not delivered, but counted: it comes as a row with a null message and its length.

``replay``: a scenario, a text file that names a fixture per line, read in that order; a
fixture that is named again is delivered again, like a redelivery.  The offset is a place
in the scenario.

Both read and write through Arrow's file systems, so a path may be a local one, or a URI of
any store that Arrow knows; executors read what they are given, and the driver only lists.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

MESSAGES = "topic string, position long, value string, n_bytes long"
FRAMES = "position long, fixture string, body string"


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


def _listed(path: str) -> list[str]:
    """The names of a folder's finished files, in order."""
    store, folder = store_of(path)
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found if f.is_file and f.base_name.endswith(".jsonl"))


def _read(path: str) -> bytes:
    store, name = store_of(path)
    with store.open_input_stream(name) as stream:
        return stream.read()


@dataclass
class _File(InputPartition):
    topic: str
    path: str
    number: int


class _TopicReader(DataSourceStreamReader):
    """Offsets are the name of the last file read of each topic; files per batch may be bounded."""

    def __init__(self, options: dict):
        self.path, self.topics = options["path"].rstrip("/"), [t for t in options.get("topics", "").split(",") if t]
        self.most = int(options.get("maxFilesPerTrigger", "0"))
        self.reached: dict[str, str] = {}

    def _names(self) -> list[str]:
        if self.topics:
            return self.topics
        store, folder = store_of(self.path)
        return sorted(f.base_name for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if not f.is_file)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = dict(self.reached)
        for topic in self._names():
            new = [n for n in _listed(f"{self.path}/{topic}") if n > out.get(topic, "")]
            if self.most:
                new = new[: self.most]
            if new:
                out[topic] = new[-1]
        self.reached = out
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.reached = dict(end)
        found = []
        for topic, last in sorted(end.items()):
            names = _listed(f"{self.path}/{topic}")
            found += [_File(topic, f"{self.path}/{topic}/{n}", k) for k, n in enumerate(names) if start.get(topic, "") < n <= last]
        return found

    def read(self, partition: _File) -> Iterator[tuple]:
        for line, raw in enumerate(_read(partition.path).splitlines()):
            position = partition.number * 1_000_000_000 + line
            try:
                text = raw.decode()
                good = isinstance(json.loads(text), dict)
            except ValueError:
                good = False
            yield (partition.topic, position, text, len(raw)) if good else (partition.topic, position, None, len(raw))


@dataclass
class _Written(WriterCommitMessage):
    files: list


class _TopicWriter(DataSourceStreamWriter):
    """Tasks write hidden files; the commit of a batch gives them their names, in order of batch and task."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")

    def write(self, iterator) -> _Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        lines: dict[str, list[bytes]] = {}
        for row in iterator:
            lines.setdefault(row.topic, []).append(row.value.encode())
        files = []
        for topic, own in lines.items():
            hidden = f"{self.path}/{topic}/_{task.taskAttemptId()}"
            store, name = store_of(hidden)
            store.create_dir(name.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(name) as out:
                out.write(b"\n".join(own) + b"\n")
            files.append((topic, task.partitionId(), hidden))
        return _Written(files)

    def commit(self, messages: list, batchId: int) -> None:
        for topic, task, hidden in sorted(f for m in messages if m for f in m.files):
            store, name = store_of(hidden)
            store.move(name, f"{name.rsplit('/', 1)[0]}/{batchId:012d}-{task:06d}.jsonl")

    def abort(self, messages: list, batchId: int) -> None:
        for m in messages:
            for _, _, hidden in m.files if m else ():
                store, name = store_of(hidden)
                store.delete_file(name)


class TopicSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "topic"

    def schema(self) -> str:
        return MESSAGES

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _TopicReader(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return _TopicWriter(self.options)


@dataclass
class _Entry(InputPartition):
    position: int
    fixture: str


class _ReplayReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.scenario = options["path"]
        self.folder = options.get("fixtures", self.scenario.rsplit("/", 1)[0])
        self.most = int(options.get("maxFramesPerTrigger", "0"))
        self.reached = 0

    def _entries(self) -> list[str]:
        return [line for line in _read(self.scenario).decode().splitlines() if line.strip()]

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        n = len(self._entries())
        self.reached = min(n, self.reached + self.most) if self.most else n
        return {"next": self.reached}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.reached = end["next"]
        return [_Entry(k, name) for k, name in enumerate(self._entries()[: end["next"]]) if k >= start["next"]]

    def read(self, partition: _Entry) -> Iterator[tuple]:
        yield partition.position, partition.fixture, _read(f"{self.folder}/{partition.fixture}").decode()


class ReplaySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> str:
        return FRAMES

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _ReplayReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes both sources known to the session."""
    spark.dataSource.register(TopicSource)
    spark.dataSource.register(ReplaySource)
