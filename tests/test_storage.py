"""Landing, topics, replays, versions and logs that are written more than once."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trackledger.operators import tables, versions
from trackledger.sources import topics
from trackledger.sources.frames import parse_td
from trackledger.streaming import ingest

T0 = datetime(2026, 1, 1, 12)


def frame(n):
    return json.dumps([{"CT_MSG": {"area_id": "ZZ", "report_time": str(n)}}])


def test_only_days_that_may_hold_a_hash_are_read(spark, tmp_path, monkeypatch):
    schema = "feed_name string, body string, received_at timestamp"
    asked = []
    found = ingest.days_to_read
    monkeypatch.setattr(ingest, "days_to_read", lambda *a: asked.append(found(*a)) or asked[-1])
    for day in range(6):
        again = [("td", frame(2), T0 + timedelta(days=day))] if day == 4 else []
        rows = [("td", frame(10 * day + k), T0 + timedelta(days=day)) for k in range(4)]
        ingest.land_batch(spark.createDataFrame(rows + again, schema), day, parse_td, str(tmp_path))
    assert [[str(d) for d in days] for days in asked] == [[], [], [], ["2026-01-01"], []]
    assert spark.read.parquet(str(tmp_path / "frames")).count() == 24
    ingest.land_batch(spark.createDataFrame([("td", frame(41), T0 + timedelta(days=9))], schema), 5, parse_td, str(tmp_path))  # the last batch once more, with another frame
    assert spark.read.parquet(str(tmp_path / "frames")).where("batch = 5").count() == 0


def messages(n, bad=()):
    return [("a" if k % 3 else "b", "{broken" if k in bad else json.dumps({"n": k})) for k in range(n)]


def test_topics_deliver_once_and_count_what_is_malformed(spark, tmp_path):
    topics.register(spark)
    kind = "topic string, value string"
    for part, rows in enumerate((messages(20, bad=(4, 7)), messages(5))):
        spark.createDataFrame(rows, kind).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        sink = spark.readStream.schema(kind).parquet(str(tmp_path / "in")).writeStream.format("topic").option("path", str(tmp_path / "topics"))
        sink.option("checkpointLocation", str(tmp_path / "sent")).trigger(availableNow=True).start().awaitTermination()
        source = spark.readStream.format("topic").option("path", str(tmp_path / "topics")).option("maxFilesPerTrigger", 1).load()
        out = source.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "read"))
        query = out.start()
        query.processAllAvailable()
        query.stop()
        got = spark.read.parquet(str(tmp_path / "out"))
        assert got.where("value is null").count() == 2
        assert got.where("value is not null").count() == (18 if not part else 23)
        assert {r.topic for r in got.collect()} == {"a", "b"}
    one = spark.readStream.format("topic").option("path", str(tmp_path / "topics")).option("topics", "b").load()
    query = one.writeStream.format("memory").queryName("only_b").option("checkpointLocation", str(tmp_path / "b")).start()
    query.processAllAvailable()
    query.stop()
    assert {r.topic for r in spark.table("only_b").collect()} == {"b"}


@pytest.mark.parametrize("most", [0, 2])
def test_a_replay_lands_what_its_fixtures_hold_once(spark, tmp_path, most):
    topics.register(spark)
    for k in range(3):
        (tmp_path / f"f{k}.json").write_text(frame(k))
    (tmp_path / "scenario.txt").write_text("f1.json\nf0.json\nf1.json\n\nf2.json\nf0.json\n")

    def replay():
        source = spark.readStream.format("replay").option("path", str(tmp_path / "scenario.txt")).option("maxFramesPerTrigger", most).load()
        frames = source.select(F.lit("td").alias("feed_name"), "body", (F.lit(T0).cast("timestamp") + F.make_interval(secs=F.col("position"))).alias("received_at"))
        run = frames.writeStream.foreachBatch(lambda batch, n: ingest.land_batch(batch, n, parse_td, str(tmp_path / "log"))).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
        run.processAllAvailable()
        run.stop()

    replay()
    assert spark.read.parquet(str(tmp_path / "log/frames")).count() == 3
    (tmp_path / "f3.json").write_text(frame(3))
    with (tmp_path / "scenario.txt").open("a") as out:
        out.write("f1.json\nf3.json\n")
    replay()  # goes on where it stopped
    assert spark.read.parquet(str(tmp_path / "log/frames")).count() == 4
    assert spark.read.parquet(str(tmp_path / "log/children")).count() == 4


def test_versions_switch_whole_and_in_one_step(spark, tmp_path):
    path, audit = str(tmp_path / "p"), str(tmp_path / "audit")
    with pytest.raises(FileNotFoundError):
        versions.current(spark, path)
    assert versions.publish(spark.range(3), path) == 1
    versions.publish(spark.createDataFrame([(1, "clear", 2)], "id long, action string, row_id long"), audit)
    old = versions.current(spark, path)

    def fails():
        raise RuntimeError("no data")

    with pytest.raises(RuntimeError):
        versions.rebuild(spark, path, fails, audit)
    assert versions.version(spark, path) == 1 and versions.current(spark, audit).first().row_id == 2
    assert versions.rebuild(spark, path, lambda: spark.range(5), audit) == 2
    assert old.count() == 3 and versions.current(spark, path).count() == 5  # readers of the old one go on
    assert tuple(versions.current(spark, audit).first()) == (1, "clear", None)
    with pytest.raises(versions.Overtaken):
        versions.publish(spark.range(9), path, expected=1)
    assert versions.current(spark, path).count() == 5
    versions.publish(spark.range(6), path)
    assert len(versions.discard_old(spark, path)) == 1 and versions.current(spark, path).count() == 6


def test_a_late_create_does_not_undo_a_newer_delete(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice("abc"), rng.choice(["create", "update", "delete"]), rng.randint(0, 9)) for k in range(60)]
    rng.shuffle(rows)
    state = None
    for at in range(0, 60, 20):
        state = tables.merged_log(state, spark.createDataFrame(rows[at : at + 20], "seq long, key string, operation string, v int"), ["key"], "seq")
    last = {}
    for row in sorted(rows):
        last[row[1]] = row
    assert sorted(map(tuple, state.collect())) == sorted(last.values())
    assert {r.key for r in tables.visible(state).collect()} == {k for k, r in last.items() if r[2] != "delete"}


def test_wanted_keys_without_events_are_reported(spark):
    events = spark.createDataFrame([("A", T0), ("A", T0 + timedelta(hours=1)), ("B", T0)], "area string, at timestamp")
    wanted = spark.createDataFrame([("A",), ("C",)], "area string")
    got = tables.diagnostics(events, wanted, ["area"], "at").orderBy("area").collect()
    assert [tuple(r) for r in got] == [("A", 2, T0, T0 + timedelta(hours=1)), ("C", 0, None, None)]
