"""Reference files: line-delimited schedules, location and berth-step lists, the archive."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from trackledger.session import kept
from trackledger.sources.frames import computed_once
from trackledger.sources.topics import store_of

#: Entries of a folder in one batch.
ENTRIES = 4096

# The wrapper keys of a schedule file's lines.
RECORDS = {"JsonTimetableV1": "header", "JsonScheduleV1": "schedule", "TiplocV1": "tiploc", "JsonAssociationV1": "association", "EOF": "trailer"}

LOCATION = "struct<location_type:string,tiploc_code:string,arrival:string,public_arrival:string,departure:string,public_departure:string,pass:string,public_pass:string,platform:string,path:string,line:string>"
SCHEDULE = (
    "transaction_type string, CIF_train_uid string, schedule_start_date string, schedule_end_date string, CIF_stp_indicator string, schedule_days_runs string, atoc_code string, train_status string,"
    f"schedule_segment struct<signalling_id:string,CIF_train_category:string,CIF_train_service_code:string,CIF_power_type:string,schedule_location:array<{LOCATION}>>"
)
CORPUS = "TIPLOCDATA array<struct<TIPLOC:string,NLC:string,NLCDESC:string,STANOX:string,CRS:string,NLCDESC16:string>>"
SMART = "BERTHDATA array<struct<STEPTYPE:string,FROMBERTH:string,TOBERTH:string,STANOX:string,EVENT:string,PLATFORM:string,TD:string,STANME:string>>"


def numbered_lines(spark: SparkSession, path: str, pieces: bool = False) -> DataFrame:
    """(file, line_no, line): lines numbered from 1 within each file.

    A file is read in blocks by many tasks; a line's number is its place in its block plus
    the lines of the blocks before, for which one row per block is enough.  Files that came
    in ``pieces`` are folders, whose pieces follow one another by name.
    """
    name = F.col("_metadata.file_path")
    parts = (F.regexp_extract(name, "^(.*)/", 1), F.regexp_extract(name, "([^/]*)$", 1)) if pieces else (name, F.lit(""))
    rows = spark.read.text(path).select("value", parts[0].alias("file"), F.struct(parts[1].alias("piece"), F.col("_metadata.file_block_start").alias("start")).alias("_block"), F.monotonically_increasing_id().alias("_id"))
    blocks = rows.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.expr("coalesce(sum(_n) over (partition by file order by _block rows between unbounded preceding and 1 preceding), 0)")
    blocks = F.broadcast(blocks.select("file", "_block", "_first", before.alias("_before")))  # a row per block
    return rows.join(blocks, ["file", "_block"]).select("file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line_no"), F.col("value").alias("line"))


def schedule_records(lines: DataFrame) -> DataFrame:
    """(file, line_no, record_type, raw, error_code): blank lines are counted but give no record."""
    lines = computed_once(lines.where(F.trim("line") != ""), _whole=F.try_parse_json("line").isNotNull())
    lines = computed_once(lines, _keys=F.json_object_keys(F.when(F.col("_whole"), F.col("line"))))
    whole, keys = F.col("_whole"), F.col("_keys")
    known = F.create_map(*[F.lit(x) for pair in RECORDS.items() for x in pair])
    kind = F.when(~whole | keys.isNull() | (F.size(keys) != 1), "malformed").otherwise(F.coalesce(known[F.element_at(keys, 1)], F.lit("unknown")))
    error = F.when(~whole, "invalid_json").when(keys.isNull(), "not_an_object").when(F.size(keys) != 1, "unexpected_wrapper_key_count")
    return lines.select("file", "line_no", kind.alias("record_type"), F.col("line").alias("raw"), error.alias("error_code"))


def complete_files(records: DataFrame, file: list[str]) -> DataFrame:
    """(file, complete): a file counts only with both its header and its trailer."""
    has = lambda kind: F.coalesce(F.bool_or(F.col("record_type") == kind), F.lit(False))
    return records.groupBy(*file).agg((has("header") & has("trailer")).alias("complete"))


def is_complete(records: DataFrame) -> bool:
    """Whether the records, of one file, are complete."""
    return bool(complete_files(records, []).first()["complete"])


def _date(value: Column) -> Column:
    return value.try_cast("date")


def schedules(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(schedules, unhandled): typed schedules with their calls, and every record that is not one.

    Deletes are neither; records that lack what a schedule must have are unhandled.
    """
    body = F.from_json(F.get_json_object("raw", "$.JsonScheduleV1"), SCHEDULE)
    rows = computed_once(records, _s=F.when(F.col("record_type") == "schedule", body))
    s = F.col("_s")
    complete = s["CIF_train_uid"].isNotNull() & _date(s["schedule_start_date"]).isNotNull() & _date(s["schedule_end_date"]).isNotNull() & s["CIF_stp_indicator"].isNotNull()
    complete = F.coalesce(complete, F.lit(False))
    deletes = F.coalesce(s["transaction_type"] == "Delete", F.lit(False))
    calls = F.coalesce(s["schedule_segment"]["schedule_location"], F.array().cast(f"array<{LOCATION}>"))
    typed = rows.where(complete & ~deletes).select(
        "line_no", s["CIF_train_uid"].alias("train_uid"), _date(s["schedule_start_date"]).alias("start_date"), _date(s["schedule_end_date"]).alias("end_date"),
        s["CIF_stp_indicator"].alias("stp"), F.nullif(s["schedule_days_runs"], F.lit("")).alias("days_run"), s["schedule_segment"]["signalling_id"].alias("signalling_id"),
        F.get(calls, F.lit(0))["tiploc_code"].alias("origin"), F.try_element_at(calls, F.lit(-1))["tiploc_code"].alias("destination"), calls.alias("calls"),
    )
    other = rows.where(~F.col("record_type").isin("header", "trailer") & ~complete & ~deletes).drop("_s")
    return typed, other


def calls_of(typed: DataFrame) -> DataFrame:
    """A row per call of each schedule, numbered from 1."""
    rows = typed.select("train_uid", "start_date", "stp", F.posexplode("calls").alias("_at", "_c"))
    return rows.select("train_uid", "start_date", "stp", (F.col("_at") + 1).alias("seq_no"), "_c.*")


def _listed(spark: SparkSession, path: str, schema: str, name: str) -> DataFrame:
    whole = spark.read.schema(schema).json(path, multiLine=True)
    if whole.where(F.col(name).isNotNull()).isEmpty():
        raise ValueError(f"no {name} in {path}")
    return whole.select(F.posexplode(name).alias("seq_no", "_r")).select("seq_no", "_r.*")


def locations(spark: SparkSession, path: str) -> DataFrame:
    """(tiploc, nlc, stanox, crs, name), the last record of a tiploc wins; the file must have its list."""
    rows = _listed(spark, path, CORPUS, "TIPLOCDATA").where(F.trim("TIPLOC") != "")
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    last = F.max_by(F.struct(clean("NLC").alias("nlc"), clean("STANOX").alias("stanox"), clean("CRS").alias("crs"), clean("NLCDESC").alias("name")), "seq_no").alias("l")
    return rows.groupBy(F.trim("TIPLOC").alias("tiploc")).agg(last).select("tiploc", "l.*")


def berth_steps(spark: SparkSession, path: str) -> DataFrame:
    """(td_area, from_berth, to_berth, event, stanox, platform), the last record of a natural key wins."""
    rows = _listed(spark, path, SMART, "BERTHDATA").where(F.trim("TD") != "")
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    key = [F.coalesce(F.trim(c), F.lit("")).alias(n) for c, n in (("TD", "td_area"), ("FROMBERTH", "from_berth"), ("TOBERTH", "to_berth"), ("EVENT", "event"))]
    last = F.max_by(F.struct(clean("STANOX").alias("stanox"), clean("PLATFORM").alias("platform")), "seq_no").alias("l")
    return rows.groupBy(*key).agg(last).select("td_area", "from_berth", "to_berth", "event", "l.*")


def archive(objects: DataFrame, path: str) -> None:
    """Writes objects (object_key, content binary), each as a file of its own under ``path``; an object that is written again is replaced."""

    def write(rows: Iterator[Row]) -> None:
        (store, root), known = store_of(path), set()
        for key, content in rows:
            folder = f"{root}/{key}".rpartition("/")[0]
            if folder not in known:
                store.create_dir(folder)
                known.add(folder)
            with store.open_output_stream(f"{root}/{key}") as out:
                out.write(content)

    objects.select("object_key", "content").foreachPartition(write)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder in batch.column("name").to_pylist():
            store, root = store_of(folder)
            own = [f for f in store.get_file_info(fs.FileSelector(root)) if not f.base_name.startswith((".", "_"))]
            for at in range(0, len(own), ENTRIES):
                part = own[at : at + ENTRIES]
                yield pa.RecordBatch.from_pydict({"name": [f"{folder}/{f.base_name}" for f in part], "size": pa.array([f.size for f in part], pa.int64()), "folder": [not f.is_file for f in part]})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for name in batch.column("name").to_pylist():
            store, own = store_of(name)
            digest = hashlib.sha256()
            with store.open_input_stream(own) as stream:
                while part := stream.read(1 << 20):
                    digest.update(part)
            found.append(digest.hexdigest())
        yield pa.RecordBatch.from_pydict({"name": batch.column("name"), "size": batch.column("size"), "sha256": pa.array(found, pa.string())})


def archived(spark: SparkSession, path: str, digests: bool = True) -> DataFrame:
    """(object_key, size, sha256) of archived objects; without digests contents are not read.

    Folders are listed by tasks, one level after the other, so that no list of all objects
    is ever in one place; contents are read a piece at a time.  Names that begin with a dot
    or an underscore are left out.
    """
    folders, found = spark.createDataFrame([(path.rstrip("/"),)], "name string"), None
    while True:
        entries = kept(folders.mapInArrow(_entries, "name string, size long, folder boolean"))
        own = entries.where("not folder").select("name", "size")
        found = own if found is None else found.unionByName(own)
        if entries.where("folder").isEmpty():
            break
        folders = entries.where("folder").select("name").repartition("name")
    key = F.regexp_extract("name", "(raw/.*)$", 1).alias("object_key")
    if not digests:
        return found.select(key, "size")
    return found.repartition("name").mapInArrow(_digests, "name string, size long, sha256 string").select(key, "size", "sha256")
