"""Queries over frames, map documents and streams, built from the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackledger import adapters as A
from trackledger.functions import clock, text
from trackledger.operators import berths, imports, maps, resolver, runs, schedules, tables
from trackledger.plans import feeds
from trackledger.plans.sql import over, upto
from trackledger.session import shared_folder
from trackledger.sources import frames
from trackledger.streaming import berth_state, deltas, ingest, live

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(views: str = "", sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = over(views, sql)
        return f

    return register


# Frames

BROKEN = 13  # every so many frames are cut short


def _ms(at):
    return F.unix_millis(at.cast("timestamp")).cast("string")


def _frames(rows, feed, child, order):
    """Frames of ten children each, some of them broken, some twice."""
    number = F.floor((F.col("seq") - 1) / 10)
    body = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, child.alias("j")))), lambda x: x["j"]), ","), F.lit("]"))
    rows = rows.groupBy(number.alias("frame")).agg(body.alias("body"), F.max("event_at").cast("timestamp").alias("received_at"))
    body = F.when(F.col("frame") % BROKEN == 0, F.concat(F.lit(f"{feed} "), F.col("frame").cast("string"))).otherwise(F.col("body"))
    return rows.select("frame", F.lit(feed).alias("feed_name"), body.alias("body"), "received_at")


def _td_frames(spark, d):
    kind = F.col("message_type")
    payload = F.struct(
        F.col("td_area").alias("area_id"), F.when(kind != "CT", _ms(F.col("event_at"))).alias("time"), F.when(kind == "CT", _ms(F.col("event_at"))).alias("report_time"),
        F.when(kind.isin("CA", "CB"), F.col("from_berth")).alias("from"), F.when(kind.isin("CA", "CC"), F.col("to_berth")).alias("to"), F.when(kind != "CT", F.col("descr")).alias("descr"),
    )
    return _frames(A.td_events(spark, d), "td", F.to_json(F.create_map(F.concat(kind, F.lit("_MSG")), payload)), F.col("seq"))


def _children(parsed, made):
    """The children with the number of their frame.

    What is parsed is larger than its columns let Spark estimate, so neither side is broadcast.
    """
    numbers = made.select("frame", F.sha2(F.col("body").cast("binary"), 256).alias("body_hash"))
    return parsed.join(numbers.hint("merge"), "body_hash")


@query("td", f"""SELECT CAST((seq-1)//10 AS BIGINT) AS frame, CAST((seq-1)%10 AS INTEGER) AS child_index, message_type AS event_type, td_area, 'parsed' AS parse_status, NULL AS error_code,
  date_trunc('millisecond', event_at) AS event_at FROM td WHERE ((seq-1)//10)%{BROKEN}<>0
  UNION ALL SELECT DISTINCT (seq-1)//10, 0, 'unknown', NULL, 'malformed', 'invalid_json', (SELECT max(t.event_at) FROM td t WHERE (t.seq-1)//10=(td.seq-1)//10) FROM td WHERE ((seq-1)//10)%{BROKEN}=0""")
def src_06_td_children(spark, d):
    made = _td_frames(spark, d)
    rows = _children(frames.parse_td(made), made)
    return rows.select("frame", "child_index", "event_type", "td_area", "parse_status", "error_code", F.col("event_at").cast("timestamp_ntz").alias("event_at"))


@query("td", f"""SELECT CAST((seq-1)//10 AS BIGINT) AS frame, CASE WHEN ((seq-1)//10)%{BROKEN}=0 THEN 1 ELSE count(*) END AS n, CASE WHEN ((seq-1)//10)%{BROKEN}=0 THEN 1 ELSE 0 END AS n_malformed,
  CASE WHEN ((seq-1)//10)%{BROKEN}=0 THEN 'failed' ELSE 'ok' END AS status FROM td GROUP BY (seq-1)//10""")
def agg_07_frame_summary(spark, d):
    made = _td_frames(spark, d)
    return _children(frames.frame_summary(frames.parse_td(made)), made).select("frame", "n", "n_malformed", "status")


@query("td", "SELECT seq, td_area, message_type, CASE WHEN message_type IN ('CA','CB') THEN from_berth END AS from_berth, CASE WHEN message_type IN ('CA','CC') THEN to_berth END AS to_berth, descr FROM td WHERE message_type<>'CT' AND ((seq-1)//10)%13<>0")
def flt_05_td_steps(spark, d):
    made = _td_frames(spark, d)
    rows = _children(frames.parse_td(made), made).withColumn("seq", F.col("frame") * 10 + F.col("child_index") + 1)
    return frames.td_steps(rows).where("message_type <> 'CT'").select("seq", "td_area", "message_type", "from_berth", "to_berth", "descr")


@query("tr", f"""SELECT CAST((seq-1)//10 AS BIGINT) AS frame, CAST((seq-1)%10 AS INTEGER) AS child_index, CASE WHEN k=99 THEN 'trust.unsupported_msg_type:0042' ELSE event_type END AS event_type, CASE WHEN k=99 THEN 'unsupported' ELSE 'parsed' END AS parse_status
  FROM tr WHERE ((seq-1)//10)%{BROKEN}<>0 UNION ALL SELECT DISTINCT (seq-1)//10, 0, 'unknown', 'malformed' FROM tr WHERE ((seq-1)//10)%{BROKEN}=0""")
def src_07_trust_children(spark, d):
    codes = F.create_map(*[F.lit(x) for code, name in frames.TRUST_KINDS.items() for x in (name, code)])
    code = F.when(F.col("k") == 99, "0042").otherwise(codes[F.col("event_type")])
    child = F.to_json(F.struct(F.struct(code.alias("msg_type")).alias("header"), F.struct(F.col("identity").cast("string").alias("train_id"), _ms(F.col("event_at")).alias("event_timestamp")).alias("body")))
    made = _frames(A.trust_events(spark, d), "trust", child, F.col("seq"))
    return _children(frames.parse_trust(made), made).select("frame", "child_index", "event_type", "parse_status")


@query("sch", "SELECT schedule_id, CASE schedule_id%5 WHEN 0 THEN 'vstp.create' WHEN 1 THEN 'vstp.overwrite' WHEN 2 THEN 'vstp.delete' WHEN 3 THEN 'vstp.update' ELSE 'vstp.unknown:Zap' END AS event_type, CASE WHEN schedule_id%5=4 THEN 'unsupported' ELSE 'parsed' END AS parse_status FROM sch")
def src_08_vstp_children(spark, d):
    order = {"Create": 0, "Overwrite": 1, "Delete": 2, "Update": 3}
    kind = F.lit("Zap")
    for name, n in order.items():
        kind = F.when(F.col("schedule_id") % 5 == n, name).otherwise(kind)
    body = F.to_json(F.struct(F.struct(F.struct(kind.alias("transaction_type"), F.col("train_uid").alias("CIF_train_uid"), F.col("schedule_id")).alias("schedule")).alias("VSTPCIFMsgV1")))
    made = A.schedules(spark, d).select("schedule_id", F.lit("vstp").alias("feed_name"), body.alias("body"), F.lit("2026-01-01").cast("timestamp").alias("received_at"))
    parsed = frames.parse_vstp(made)
    return parsed.select(F.get_json_object("raw_event", "$.VSTPCIFMsgV1.schedule.schedule_id").cast("long").alias("schedule_id"), "event_type", "parse_status")


@query("td", "SELECT count(*) AS n FROM (SELECT DISTINCT (seq-1)//10 AS f FROM td) WHERE f%3<>0")
def snk_02_str_03_landing(spark, d):
    made = _td_frames(spark, d)
    twice = made.unionByName(made.where("frame % 2 = 0")).drop("frame")
    return frames.land(twice, frames.land(made.where("frame % 3 = 0").drop("frame"))).agg(F.count("*").alias("n"))


@query("td", f"SELECT feed_name, error_code, count(*) AS n FROM (SELECT DISTINCT 'td' AS feed_name, 'invalid_json' AS error_code, (seq-1)//10 AS f FROM td WHERE ((seq-1)//10)%{BROKEN}=0) GROUP BY 1,2")
def snk_08_dead_letters(spark, d):
    rows = frames.parse_td(_td_frames(spark, d)).where("parse_status = 'malformed'")
    return rows.groupBy("feed_name", "error_code").agg(F.count("*").alias("n"))


@query("ev", """SELECT event_id, CASE WHEN k%5=0 OR k%7=0 THEN 'unparseable' WHEN k%3=0 THEN 'implausible_skew' ELSE 'none' END AS code, CASE WHEN k%5=0 OR k%7=0 OR k%3=0 THEN ts ELSE date_trunc('millisecond', ts) END AS event_at FROM ev""")
def s_01_normalized_times(spark, d):
    k, at = F.get_json_object("props", "$.k").cast("int"), F.col("ts").cast("timestamp")
    raw = F.when(k % 5 == 0, "never").when(k % 7 == 0, "-3").when(k % 3 == 0, (F.unix_millis(at) - 90_000_000).cast("string")).otherwise(F.unix_millis(at).cast("string"))
    time, code, _ = clock.normalized(raw, at)
    return A.table(spark, d, "events").select("event_id", code.alias("code"), time.cast("timestamp_ntz").alias("event_at"))


@query("ev", """SELECT event_id, CASE WHEN k%4=0 THEN 'on time' WHEN k%4=1 AND k%3<>0 THEN 'approximately '||CAST(k AS VARCHAR)||' early' WHEN k%4=2 AND k%3<>0 THEN 'approximately '||CAST(k AS VARCHAR)||' late' WHEN k%4=3 THEN 'off route' END AS shown FROM ev""")
def s_07_s_08_running(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(k % 4 == 0, "ON TIME").when(k % 4 == 1, "EARLY").when(k % 4 == 2, "LATE").otherwise("OFF ROUTE")
    payload = F.to_json(F.struct(F.struct(status.alias("variation_status"), F.when(k % 3 == 0, "?").otherwise(F.lpad(k.cast("string"), 3, "0")).alias("timetable_variation")).alias("body")))
    found, minutes, *_ = text.movement_report(payload)
    return A.table(spark, d, "events").select("event_id", text.running_indication(found, minutes, F.lit(None).cast("string")).alias("shown"))


@query("ref", "SELECT tiploc, tiploc||'|'||stanox AS key, name||' ('||tiploc||')' AS shown, CASE WHEN length(name)=10 THEN substr(name,3,4) END AS head FROM ref")
def s_11_s_16_s_20_labels(spark, d):
    return A.location_reference(spark, d).select("tiploc", text.composite_key(F.col("tiploc"), F.col("stanox")).alias("key"), text.shown_location(F.col("tiploc"), F.col("name")).alias("shown"), text.headcode(F.col("name")).alias("head"))


# More joins

NOW = "2024-01-20 12:00:00"


@query("decided occ", f"SELECT x.occupancy_id, x.status, o.td_area, o.berth FROM decided x JOIN occ o USING (occupancy_id) WHERE o.berth IN ('0001','0005') AND o.entered_at<=TIMESTAMP '{NOW}' AND (o.left_at IS NULL OR o.left_at>=TIMESTAMP '{NOW}' - INTERVAL 1 HOUR)")
def joi_06_recent_resolutions(spark, d):
    occ = berths.occupancies(A.td_events(spark, d))
    wanted = spark.createDataFrame([("0001",), ("0005",)], "berth string")
    at = F.lit(NOW).cast("timestamp_ntz")
    near = occ.join(wanted, "berth", "left_semi").where((F.col("entered_at") <= at) & (F.col("left_at").isNull() | (F.col("left_at") >= at - F.expr("INTERVAL 1 HOUR"))))
    return feeds._decided(spark, d, near, "td_area", "berth").select("occupancy_id", "status", "td_area", "berth")


@query("bind sch", "SELECT b.slug, b.element_id, v.schedule_id AS version FROM bind b JOIN (SELECT CASE WHEN schedule_id%2=0 THEN 'north' ELSE 'south' END AS slug, max(schedule_id) AS schedule_id FROM sch GROUP BY 1) v USING (slug)")
def joi_10_open_versions(spark, d):
    versions = A.schedules(spark, d).select(F.when(F.col("schedule_id") % 2 == 0, "north").otherwise("south").alias("slug"), F.col("schedule_id").alias("version"))
    last = versions.groupBy("slug").agg(F.max("version").alias("last"))  # every version but the last ends where the next begins
    versions = versions.join(last, "slug").withColumn("effective_to", F.when(F.col("version") < F.col("last"), F.col("version") + 1))
    return A.map_bindings(spark).join(versions.where("effective_to is null"), "slug").select("slug", "element_id", "version")


@query("decided occ cur", "SELECT x.occupancy_id, x.status, x.run_id FROM decided x JOIN occ o USING (occupancy_id) JOIN cur c ON c.td_area=o.td_area AND c.berth=o.berth AND c.source_seq=o.occupancy_id")
def joi_11_still_current(spark, d):
    now = berths.current_state(A.td_events(spark, d)).where("descr is not null").select(F.col("source_seq").alias("occupancy_id"))
    occ = berths.occupancies(A.td_events(spark, d)).join(now, "occupancy_id", "left_semi")
    return feeds._decided(spark, d, occ).select("occupancy_id", "status", "run_id")


_SOURCED = "(SELECT *, CASE WHEN schedule_id%2=0 THEN 'SCHEDULE' ELSE 'VSTP' END AS source FROM sch)"


@query("sch loc", f"SELECT a.schedule_id, l.seq_no, l.tiploc FROM (SELECT train_uid, start_date, end_date, stp, source, min(schedule_id) AS schedule_id FROM {_SOURCED} GROUP BY ALL) a JOIN (SELECT s.train_uid, s.start_date, s.end_date, s.stp, s.source, l.seq_no, l.tiploc FROM loc l JOIN {_SOURCED} s USING (schedule_id)) l USING (train_uid, start_date, end_date, stp, source)")
def joi_14_staged_children(spark, d):
    key = ["train_uid", "start_date", "end_date", "stp", "source"]
    s = A.schedules(spark, d).withColumn("source", F.when(F.col("schedule_id") % 2 == 0, "SCHEDULE").otherwise("VSTP"))
    staged = A.schedule_locations(spark, d).join(s.select("schedule_id", *key), "schedule_id")
    upserted = s.groupBy(*key).agg(F.min("schedule_id").alias("schedule_id"))
    return imports.staged_children(staged, upserted, key, "schedule_id").select("schedule_id", F.col("seq_no").cast("long").alias("seq_no"), "tiploc")


@query("scored runs", "SELECT s.occupancy_id, string_agg(s.run_id||':'||CAST(s.score AS VARCHAR)||':'||r.train_uid, ',' ORDER BY s.score DESC, s.run_id) AS candidates FROM scored s JOIN runs r USING (run_id) GROUP BY 1")
def joi_17_srt_09_enriched_candidates(spark, d):
    return resolver.candidate_texts(berths.occupancies(A.td_events(spark, d)), *feeds._evidence(spark, d), told="train_uid")


@query("td", f"SELECT CAST((seq-1)//10 AS BIGINT) AS frame, count(*) AS n_steps, min(seq) AS first_seq FROM td WHERE ((seq-1)//10)%{BROKEN}<>0 AND message_type='CA' GROUP BY 1")
def joi_20_lineage(spark, d):
    made = _td_frames(spark, d)
    kids = _children(frames.parse_td(made), made).where("event_type = 'CA'").select("frame", "body_hash", (F.col("frame") * 10 + F.col("child_index") + 1).alias("seq"))
    steps = A.td_events(spark, d).select("seq", "message_type")
    return kids.join(steps, "seq").groupBy("frame").agg(F.count("*").alias("n_steps"), F.min("seq").alias("first_seq"))


# Map documents: one per nation, drawn from its customers

_ELEM = """elem AS (SELECT c_nationkey AS map_id, c_custkey AS pos, 'e'||CAST(c_custkey%400 AS VARCHAR) AS id, CASE c_custkey%6 WHEN 0 THEN 'trackPath' WHEN 1 THEN 'platform' WHEN 2 THEN 'signal' WHEN 3 THEN 'label' WHEN 4 THEN 'boundary' ELSE 'berth' END AS type,
  'l'||CAST(c_custkey%4 AS VARCHAR) AS layer_id, c_custkey%7 AS z, CAST(c_custkey%101 AS DOUBLE) AS x, CAST(c_custkey%53 AS DOUBLE) AS y FROM customer),
lay AS (SELECT n_nationkey AS map_id, i AS pos, 'l'||CAST(i AS VARCHAR) AS id, 3-i AS ord FROM nation, (SELECT unnest(range(3)) AS i)),
bnd AS (SELECT map_id, pos, 'b'||CAST(pos AS VARCHAR) AS id, id AS element_id, CASE WHEN pos%5=0 THEN 'tdSBit' ELSE 'tdBerth' END AS type, 'A'||CAST(pos%5 AS VARCHAR) AS td_area, lpad(CAST(pos%14 AS VARCHAR),4,'0') AS berth, pos%13=0 AS allow_duplicate FROM elem WHERE type='berth' AND pos%4<>1),
nod AS (SELECT map_id, pos, id FROM elem WHERE pos%3=0), edg AS (SELECT map_id, pos, 'g'||CAST(pos AS VARCHAR) AS id, id AS from_node, 'e'||CAST((pos+3)%400 AS VARCHAR) AS to_node FROM elem WHERE pos%3=0)"""


def _document(spark, d) -> maps.Document:
    key = F.col("c_custkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("trackPath", "platform", "signal", "label", "boundary", "berth")]), (key % 6 + 1).cast("int"))
    x, y = (key % 101).cast("double"), (key % 53).cast("double")
    elements = A.table(spark, d, "customer").select(
        F.col("c_nationkey").alias("map_id"), key.alias("pos"), F.concat(F.lit("e"), (key % 400).cast("string")).alias("id"), kind.alias("type"), F.concat(F.lit("l"), (key % 4).cast("string")).alias("layer_id"),
        (key % 7).alias("z"), x.alias("x"), y.alias("y"), F.array(F.struct(x.alias("x"), y.alias("y")), F.struct((x + 5).alias("x"), y.alias("y"))).alias("points"),
        F.when(key % 12 == 4, "elsewhere").alias("adjacent_map"), F.lit("up").alias("direction"),
    )
    layers = A.table(spark, d, "nation").select(F.col("n_nationkey").alias("map_id"), F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("pos"))
    layers = layers.select("map_id", "pos", F.concat(F.lit("l"), F.col("pos").cast("string")).alias("id"), (3 - F.col("pos")).alias("order"))
    pos = F.col("pos")
    bindings = elements.where("type = 'berth' and pos % 4 <> 1").select(
        "map_id", "pos", F.concat(F.lit("b"), pos.cast("string")).alias("id"), F.col("id").alias("element_id"), F.when(pos % 5 == 0, "tdSBit").otherwise("tdBerth").alias("type"),
        F.concat(F.lit("A"), (pos % 5).cast("string")).alias("td_area"), F.lpad((pos % 14).cast("string"), 4, "0").alias("berth"), F.lit("0").alias("address"), F.lit(1).alias("bit"), (pos % 13 == 0).alias("allow_duplicate"),
    )
    nodes = elements.where("pos % 3 = 0").select("map_id", "pos", "id")
    edges = nodes.select("map_id", "pos", F.concat(F.lit("g"), pos.cast("string")).alias("id"), F.col("id").alias("from_node"), F.concat(F.lit("e"), ((pos + 3) % 400).cast("string")).alias("to_node"))
    return maps.Document(elements, layers, bindings, nodes, edges)


@query(sql=f"""WITH {_ELEM} SELECT map_id, code, count(*) AS n FROM (
  SELECT map_id, 'duplicate_element_id' AS code FROM (SELECT *, row_number() OVER (PARTITION BY map_id, id ORDER BY pos) AS r FROM elem) WHERE r>1
  UNION ALL SELECT map_id, 'missing_layer' FROM elem WHERE (map_id, layer_id) NOT IN (SELECT map_id, id FROM lay)
  UNION ALL SELECT map_id, 'topology_edge_missing_node' FROM edg e WHERE NOT EXISTS (SELECT 1 FROM nod n WHERE n.map_id=e.map_id AND n.id=e.from_node) OR NOT EXISTS (SELECT 1 FROM nod n WHERE n.map_id=e.map_id AND n.id=e.to_node)
  UNION ALL SELECT e.map_id, 'missing_berth_binding' FROM elem e WHERE e.type='berth' AND NOT EXISTS (SELECT 1 FROM bnd b WHERE b.map_id=e.map_id AND b.element_id=e.id)
  UNION ALL SELECT e.map_id, 'invalid_berth_binding' FROM elem e JOIN (SELECT map_id, element_id, max_by(type,pos) AS type FROM bnd GROUP BY 1,2) b ON b.map_id=e.map_id AND b.element_id=e.id WHERE e.type='berth' AND b.type<>'tdBerth'
  UNION ALL SELECT map_id, 'duplicate_berth_binding' FROM bnd WHERE type='tdBerth' GROUP BY map_id, td_area, berth HAVING count(*)>1 AND NOT bool_or(allow_duplicate)) GROUP BY 1,2""")
def doc_02_issues(spark, d):
    return maps.issues(_document(spark, d)).groupBy("map_id", "code").agg(F.count("*").alias("n"))


@query("td", f"""SELECT map_id, element_id FROM (WITH {_ELEM} SELECT b.* FROM bnd b WHERE b.type='tdBerth') b WHERE (td_area, berth) NOT IN (SELECT td_area, to_berth FROM td)""")
def doc_03_unobserved_bindings(spark, d):
    seen = A.td_events(spark, d).select("td_area", F.col("to_berth").alias("berth"))
    none = spark.createDataFrame([("elsewhere",)], "slug string")
    return maps.warnings(_document(spark, d), none, seen).select("map_id", "element_id")


@query(sql=f"""WITH {_ELEM} SELECT map_id, CASE WHEN type='tdBerth' THEN 'berth' ELSE 's_bit' END AS kind, CASE WHEN type='tdBerth' THEN td_area||'|'||berth ELSE td_area||'|0|1' END AS key, max_by(element_id, pos) AS element_id FROM bnd GROUP BY 1,2,3""")
def doc_04_doc_08_binding_index(spark, d):
    return maps.binding_index(_document(spark, d))


@query(sql=f"""WITH {_ELEM}, e2 AS (SELECT map_id, pos, from_node AS node, to_node AS other, 0 AS h FROM edg UNION ALL SELECT map_id, pos, to_node, from_node, 1 FROM edg)
  SELECT n.map_id, n.id AS node, coalesce(string_agg(e.other, ',' ORDER BY e.pos, e.h), '') AS neighbours FROM (SELECT DISTINCT map_id, id FROM nod) n LEFT JOIN e2 e ON e.map_id=n.map_id AND e.node=n.id GROUP BY 1,2""")
def doc_05_agg_11_adjacency(spark, d):
    return maps.adjacency(_document(spark, d)).select("map_id", "node", F.array_join("neighbours", ",").alias("neighbours"))


@query(sql=f"""WITH {_ELEM}, p AS (SELECT map_id, x, y FROM elem UNION ALL SELECT map_id, x+5, y FROM elem WHERE type IN ('trackPath','platform'))
  SELECT map_id, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, greatest(max(x)-min(x)+80,100) AS width, greatest(max(y)-min(y)+80,100) AS height FROM p GROUP BY 1""")
def doc_06_agg_10_bounding_boxes(spark, d):
    return maps.bounding_boxes(_document(spark, d))


@query(sql=f"WITH {_ELEM} SELECT e.map_id, e.pos, coalesce(l.ord*1000000.0+e.z, 1e300) AS paint_key FROM elem e LEFT JOIN lay l ON l.map_id=e.map_id AND l.id=e.layer_id")
def srt_08_paint_order(spark, d):
    key = F.when(F.col("paint_key") == float("inf"), 1e300).otherwise(F.col("paint_key"))
    return maps.painted(_document(spark, d)).select("map_id", "pos", key.alias("paint_key"))


@query("td", f"""SELECT map_id, n_elements, n_berths, n_bound, observed_percent FROM (WITH {_ELEM}, s AS (SELECT DISTINCT td_area, to_berth AS berth FROM td)
  SELECT e.map_id, e.n_elements, e.n_berths, coalesce(b.n,0) AS n_bound, CASE WHEN coalesce(b.n,0)>0 THEN round(100.0*b.o/b.n) ELSE 0 END AS observed_percent FROM (SELECT map_id, count(*) AS n_elements, count(*) FILTER (WHERE type='berth') AS n_berths FROM elem GROUP BY 1) e
  LEFT JOIN (SELECT b.map_id, count(*) AS n, count(s.berth) AS o FROM bnd b LEFT JOIN s ON s.td_area=b.td_area AND s.berth=b.berth WHERE b.type='tdBerth' GROUP BY 1) b USING (map_id))""")
def agg_09_element_counts(spark, d):
    seen = A.td_events(spark, d).select("td_area", F.col("to_berth").alias("berth"))
    return maps.element_counts(_document(spark, d), seen)


# Streams


def _stream(spark, d, rows, run, kind):
    """Runs a stream over the rows, the older half in one batch, and gives what it wrote."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    middle = rows.agg(F.avg("seq")).first()[0] or 0
    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for half in (F.col("seq") <= middle, F.col("seq") > middle):
        rows.where(half).repartition(files).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    sink = run(source).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
    with deltas.stateful(spark):
        sink.outputMode(kind).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("occ", "SELECT td_area, berth, occupancy_id, descr, exit_seq, exit_reason FROM occ WHERE exit_seq IS NOT NULL")
def str_05_occupancy_stream(spark, d):
    touched = berths.touches(A.td_events(spark, d)).withColumn("event_at", F.col("event_at").cast("timestamp"))
    out = _stream(spark, d, touched, berth_state.occupancy_stream, "append")
    return out.where("occupancy_id is not null").select("td_area", "berth", "occupancy_id", "descr", "exit_seq", "exit_reason")


@query("td", "SELECT DISTINCT 'td' AS feed_name, (seq-1)//10 AS body_hash FROM td")
def str_03_dedup_stream(spark, d):
    rows = A.td_events(spark, d).select("seq", F.lit("td").alias("feed_name"), F.floor((F.col("seq") - 1) / 10).alias("body_hash"))
    return _stream(spark, d, rows, ingest.without_redelivery, "append").select("feed_name", "body_hash")


@query("td", """SELECT feed_name, window_start, coalesce(n,0) AS n FROM (SELECT 'td' AS feed_name, unnest(generate_series(min(w), max(w), INTERVAL 1 HOUR)) AS window_start FROM (SELECT time_bucket(INTERVAL 1 HOUR, event_at) AS w FROM td))
  LEFT JOIN (SELECT time_bucket(INTERVAL 1 HOUR, event_at) AS window_start, count(*) AS n FROM td GROUP BY 1) USING (window_start)""")
def str_11_ingest_windows(spark, d):
    at = F.col("event_at").cast("timestamp")
    rows = A.td_events(spark, d).select(F.lit("td").alias("feed_name"), at.alias("received_at"), at.alias("event_at"), F.lit(1.0).alias("processing_ms"))
    stats = ingest.with_empty_windows(ingest.ingest_stats(rows, 3600), 3600)
    return stats.select("feed_name", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


def _snapshots(spark, d, before_last_poll=False):
    """The state now, or a poll interval before the last event; a sequence counts two per event: what it clears, then what it fills."""
    td = A.td_events(spark, d)
    if before_last_poll:
        last = A.table(spark, d, "events").agg((F.max("ts") - F.expr(f"INTERVAL {POLL}")).alias("_until"))
        td = td.join(F.broadcast(last), F.col("event_at") <= F.col("_until")).drop("_until")  # one row
    entered = F.when(F.col("descr").isNotNull(), F.col("event_at")).alias("entered_at")
    state = A.map_bindings(spark).join(berths.current_state(td), ["td_area", "berth"], "left")
    return state.select("slug", "element_id", "descr", entered, F.coalesce(F.col("source_seq") * 2 + 1, F.lit(0)).alias("sequence"))


POLL = "1 DAY"
_STATE = ("bind cur", "SELECT b.slug, b.element_id, c.descr, CASE WHEN c.descr IS NOT NULL THEN c.event_at END AS entered_at, coalesce(c.source_seq*2+1,0) AS sequence FROM bind b LEFT JOIN cur c USING (td_area, berth)")
_NOW, _BEFORE = f"({over(*_STATE)})", upto(POLL, *_STATE)


@query(sql=f"""WITH o AS (SELECT * FROM {_BEFORE}), d AS (SELECT n.*, row_number() OVER (PARTITION BY n.slug ORDER BY n.element_id) AS i, l.last FROM {_NOW} n LEFT JOIN o USING (slug, element_id)
  JOIN (SELECT slug, max(sequence) AS last FROM o GROUP BY 1) l ON l.slug=n.slug WHERE n.descr IS DISTINCT FROM o.descr OR n.entered_at IS DISTINCT FROM o.entered_at)
  SELECT slug, element_id, CASE WHEN descr IS NULL THEN 'berth.cleared' ELSE 'berth.updated' END AS message, descr, i+greatest(last, max(sequence-i) OVER (PARTITION BY slug ORDER BY i)) AS sequence FROM d""")
def str_07_win_08_poll_deltas(spark, d):
    return live.poll_deltas(_snapshots(spark, d, before_last_poll=True), _snapshots(spark, d))


@query("td bind", f"""SELECT s.slug, s.element_id, CASE WHEN x.sequence IS NULL THEN s.descr ELSE x.descr END AS descr, coalesce(x.sequence, s.sequence) AS sequence FROM {_BEFORE} s
  LEFT JOIN (SELECT slug, element_id, descr, sequence FROM (SELECT b.slug, b.element_id, c.descr, c.seq*2+c.n AS sequence, row_number() OVER (PARTITION BY b.slug, b.element_id ORDER BY c.seq*2+c.n DESC) AS k
  FROM {feeds._CHANGES} c JOIN bind b ON b.td_area=c.td_area AND b.berth=c.berth JOIN (SELECT slug, max(sequence) AS taken FROM {_BEFORE} GROUP BY slug) t ON t.slug=b.slug WHERE c.seq*2+c.n>t.taken) WHERE k=1) x USING (slug, element_id)""")
def str_09_snapshot_and_deltas(spark, d):
    deltas = feeds.red_18_map_deltas(spark, d).select("slug", "element_id", "descr", (F.col("seq") * 2 + F.col("n")).alias("sequence"))
    return live.folded(_snapshots(spark, d, before_last_poll=True), deltas)


@query("sch", "SELECT train_uid, count(*) AS n FROM sch WHERE (train_uid, stp) NOT IN (SELECT train_uid, stp FROM sch WHERE schedule_id%4=0 AND stp='P') GROUP BY 1")
def set_04_snk_09_deletes(spark, d):
    s = A.schedules(spark, d)
    gone = s.where("schedule_id % 4 = 0 and stp = 'P'").select("train_uid", "stp").dropDuplicates()
    return s.join(gone, ["train_uid", "stp"], "left_anti").groupBy("train_uid").agg(F.count("*").alias("n"))


# Repairs and listings


@query("td", f"SELECT CAST((seq-1)//10 AS BIGINT) AS frame, CAST((seq-1)%10 AS INTEGER) AS child_index, 'unsupported' AS old_status, 'parsed' AS new_status FROM td WHERE ((seq-1)//10)%{BROKEN}<>0 AND message_type='CT'")
def snk_17_reparsed(spark, d):
    made = _td_frames(spark, d)
    now = frames.parse_td(made)
    ct = F.col("event_type") == "CT"
    before = now.withColumn("parse_status", F.when(ct, "unsupported").otherwise(F.col("parse_status")))  # as a parser without heartbeats had it
    return _children(imports.reparsed(before, now), made).select("frame", "child_index", "old_status", "new_status")


@query(sql=f"""WITH {_ELEM}, full_index AS (SELECT map_id, 'berth' AS kind, td_area||'|'||berth AS key, max_by(element_id, pos) AS element_id FROM bnd WHERE type='tdBerth' GROUP BY 1,2,3) SELECT * FROM full_index""")
def snk_21_backfilled_bindings(spark, d):
    whole = maps.binding_index(_document(spark, d)).where("kind = 'berth'")
    return imports.backfilled(whole.where("map_id % 3 = 0"), whole)


@query(sql=f"WITH {_ELEM} SELECT e.map_id, e.pos, e.id FROM elem e JOIN lay l ON l.map_id=e.map_id AND l.id=e.layer_id WHERE l.pos<>1")
def flt_13_visible_elements(spark, d):
    doc = _document(spark, d)
    visible = doc.layers.where("pos <> 1").select("map_id", F.col("id").alias("layer_id"))
    return doc.elements.join(visible, ["map_id", "layer_id"], "left_semi").select("map_id", "pos", "id")


@query("bind decided occ", """SELECT b.slug, b.element_id, x.status, x.run_id, 1000+row_number() OVER (PARTITION BY b.slug ORDER BY o.occupancy_id, b.element_id) AS sequence FROM occ o JOIN decided x USING (occupancy_id) JOIN bind b USING (td_area, berth) WHERE o.exit_seq IS NULL""")
def red_19_resolution_deltas(spark, d):
    now = berths.occupancies(A.td_events(spark, d)).where("exit_seq is null")
    rows = feeds._decided(spark, d, now, "td_area", "berth").join(A.map_bindings(spark), ["td_area", "berth"])
    return tables.sequenced(rows, "slug", ["occupancy_id", "element_id"], F.lit(1000).cast("long")).select("slug", "element_id", "status", "run_id", "sequence")


@query("runs link decided occ", """SELECT r.run_id, r.state, r.n_events, k.outcome, e.occupancy_id AS last_occupancy_id, e.score FROM runs r LEFT JOIN link k USING (run_id)
  LEFT JOIN (SELECT run_id, max(occupancy_id) AS occupancy_id, max_by(score, occupancy_id) AS score FROM decided WHERE status='matched' GROUP BY 1) e USING (run_id)""")
def res_10_run_details(spark, d):
    own = runs.runs(A.trust_events(spark, d))
    links = schedules.link_runs(own, A.schedules(spark, d, A.SCHEDULE_SHIFT_DAYS)).select("run_id", "outcome")
    last = feeds._decided(spark, d).where("status = 'matched'").groupBy("run_id").agg(F.max("occupancy_id").alias("last_occupancy_id"), F.max_by("score", "occupancy_id").alias("score"))
    return own.select("run_id", "state", "n_events").join(links, "run_id", "left").join(last, "run_id", "left")


@query("decided occ", "SELECT x.occupancy_id, x.status FROM decided x JOIN occ o USING (occupancy_id) WHERE o.entered_at > (SELECT max(entered_at) FROM occ) - INTERVAL 6 HOUR")
def str_06_recent_decisions(spark, d):
    occ = berths.occupancies(A.td_events(spark, d))
    newest = occ.agg(F.max("entered_at")).first()[0]
    recent = occ.where(F.col("entered_at") > F.lit(newest).cast("timestamp_ntz") - F.expr("INTERVAL 6 HOURS"))
    return feeds._decided(spark, d, recent).select("occupancy_id", "status")


@query("tr marked td", """SELECT 'trust' AS projector, count(*) AS n_read, count(*) FILTER (WHERE seq>=created_seq) AS n_applied, count(*) FILTER (WHERE created_seq IS NULL OR seq<created_seq) AS n_skipped FROM marked
  UNION ALL SELECT 'td', count(*), count(*) FILTER (WHERE message_type<>'CT'), count(*) FILTER (WHERE message_type='CT') FROM td""")
def agg_16_projector_summaries(spark, d):
    marked = runs._marked(A.trust_events(spark, d))
    applied = F.coalesce(F.col("seq") >= F.col("created_seq"), F.lit(False))
    count = lambda rows, name, ok: rows.agg(F.lit(name).alias("projector"), F.count("*").alias("n_read"), F.count_if(ok).alias("n_applied"), F.count_if(~ok).alias("n_skipped"))
    return count(marked, "trust", applied).unionByName(count(A.td_events(spark, d), "td", F.col("message_type") != "CT"))


@query("bind cur", "SELECT b.slug, count(*) AS n_elements, count(c.descr) AS n_occupied, coalesce(max(c.source_seq),0) AS sequence FROM bind b LEFT JOIN cur c USING (td_area, berth) GROUP BY 1")
def res_11_map_list(spark, d):
    state = feeds.joi_09_map_state(spark, d)
    return state.groupBy("slug").agg(F.count("*").alias("n_elements"), F.count("descr").alias("n_occupied"), F.coalesce(F.max("source_seq"), F.lit(0)).alias("sequence"))


@query("occ", "SELECT descr, td_area, min(entered_at) AS first_at, max(entered_at) AS last_at, count(*) AS n_berths FROM (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY descr, td_area ORDER BY entered_at, occupancy_id) AS leg FROM (SELECT *, entered_at - lag(entered_at) OVER (PARTITION BY descr, td_area ORDER BY entered_at, occupancy_id) > INTERVAL 2 HOUR AS gap FROM occ)) GROUP BY descr, td_area, leg")
def red_21_followed_runs(spark, d):
    return berths.followed_legs(berths.occupancies(A.td_events(spark, d)), "2 HOURS")


# What an editor and a client are told of maps


@query("td", f"""SELECT i.map_id, counts AS element_counts, coalesce(n_bound,0) AS n_bound_berths, coalesce(n_unbound,0) AS n_unbound_berths, coalesce(share,0.0) AS observed_percent FROM (WITH {_ELEM} SELECT k.map_id, k.counts, b.n_bound, b.n_unbound, o.share FROM
  (SELECT map_id, string_agg(type||':'||CAST(n AS VARCHAR), ',' ORDER BY type) AS counts FROM (SELECT map_id, type, count(*) AS n FROM elem GROUP BY 1,2) GROUP BY 1) k
  LEFT JOIN (SELECT e.map_id, count(*) FILTER (WHERE (e.map_id, e.id) IN (SELECT map_id, element_id FROM bnd)) AS n_bound, count(*) FILTER (WHERE (e.map_id, e.id) NOT IN (SELECT map_id, element_id FROM bnd)) AS n_unbound FROM elem e WHERE e.type='berth' GROUP BY 1) b USING (map_id)
  LEFT JOIN (SELECT map_id, round(100.0*count(*) FILTER (WHERE (td_area, berth) IN (SELECT td_area, to_berth FROM td))/count(*)) AS share FROM bnd WHERE type='tdBerth' GROUP BY 1) o USING (map_id)) i""")
def doc_03_info(spark, d):
    seen = A.td_events(spark, d).select("td_area", F.col("to_berth").alias("berth"))
    found = maps.info(_document(spark, d), seen)
    shown = F.array_join(F.transform(F.map_entries("element_counts"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return found.withColumn("element_counts", shown)


_VERSIONS = "(SELECT train_uid AS slug, row_number() OVER (PARTITION BY train_uid ORDER BY start_date, schedule_id) AS version, start_date AS a, lead(start_date) OVER (PARTITION BY train_uid ORDER BY start_date, schedule_id) AS b FROM sch)"


def _map_versions(spark, d):
    """Versions per train, each from its start on and until the next one's."""
    order = Window.partitionBy("train_uid").orderBy("start_date", "schedule_id")
    return A.schedules(spark, d).select(F.col("train_uid").alias("slug"), F.row_number().over(order).alias("version"), F.col("start_date").alias("effective_from"), F.lead("start_date").over(order).alias("effective_to"))


@query("sch", f"""SELECT w.slug, w.at, v.version, v.version IS NOT NULL AS found FROM (SELECT DISTINCT train_uid AS slug, DATE '{feeds.DAY}' AS at FROM sch UNION SELECT DISTINCT train_uid, DATE '1980-01-01' FROM sch) w
  LEFT JOIN {_VERSIONS} v ON v.slug=w.slug AND v.a<=w.at AND (v.b IS NULL OR v.b>w.at)""")
def res_11_definition_at(spark, d):
    """The version of each map in effect on a day, and before there was any."""
    versions = _map_versions(spark, d)
    days = F.explode(F.array(F.to_date(F.lit(feeds.DAY)), F.to_date(F.lit("1980-01-01")))).alias("at")
    return maps.effective_at(versions, versions.select("slug").distinct().select("slug", days))


_LAST = "(SELECT td_area, max(event_at) AS last_at FROM td GROUP BY 1)"


@query("td bind", f"""SELECT a.td_area AS slug, 2 AS version, l.last_at, CASE WHEN l.last_at IS NULL THEN 'unknown' WHEN epoch_ms(TIMESTAMP '{NOW}')-epoch_ms(l.last_at)<=90000 THEN 'ok' ELSE 'stale' END AS live_status FROM (SELECT DISTINCT td_area FROM bind) a LEFT JOIN {_LAST} l USING (td_area)""")
def res_11_map_status(spark, d):
    """A map per bound area in its second version, one of them of an area that sends nothing."""
    shown = A.map_bindings(spark).select(F.col("td_area").alias("slug"), "td_area").distinct()
    day = lambda n: F.lit(f"2024-01-0{n}").cast("timestamp")
    one = lambda n, end: F.struct(F.lit(n).alias("version"), day(n).alias("effective_from"), end.alias("effective_to"))
    made = F.array(one(1, day(2)), one(2, F.lit(None).cast("timestamp")))
    versions = shown.select("slug", F.explode(made).alias("v")).select("slug", "v.*")
    last = A.td_events(spark, d).groupBy("td_area").agg(F.max("event_at").alias("last_at"))
    status = lambda at, now: clock.live_status(at.cast("timestamp"), now)
    return maps.listed(versions, shown, last, F.lit(NOW).cast("timestamp"), status)
