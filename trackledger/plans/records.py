"""Queries from frames to records, and of the resolver's driver, built from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackledger import adapters as A
from trackledger.functions import text
from trackledger.operators import berths, imports, maps, paging, resolver, tables
from trackledger.plans.documents import _ELEM, BROKEN, _children, _document, _frames, _ms
from trackledger.plans.feeds import DAY, _best
from trackledger.plans.sql import CANDIDATES, VIEWS, in_order, over
from trackledger.sources import frames, records

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(views: str, sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = over(views, sql)
        return f

    return register


def _id(identity):
    """A train id of ten characters, whose third to sixth are a headcode."""
    return F.concat(F.lit("87"), A.headcode(identity), F.lpad((identity % 10000).cast("string"), 4, "0"))


_SQL_ID = "'87'||signalling_id||lpad(CAST(identity%10000 AS VARCHAR),4,'0')"


@query("tr", f"""SELECT seq, event_type, CASE WHEN event_type='movement' AND seq%11=0 THEN NULL ELSE {_SQL_ID} END AS train_id, CASE WHEN event_type='activation' THEN train_uid END AS train_uid,
  CASE WHEN event_type='activation' THEN signalling_id END AS signalling_id, CASE WHEN event_type='activation' THEN 'T'||CAST(k%7 AS VARCHAR) END AS operator_code FROM tr WHERE ((seq-1)//10)%{BROKEN}<>0""")
def flt_12_trust_identities(spark, d):
    kind, seq, own = F.col("event_type"), F.col("seq"), _id(F.col("identity"))
    codes = F.create_map(*[F.lit(x) for code, name in frames.TRUST_KINDS.items() for x in (name, code)])
    nested = kind.isin("cancellation", "reinstatement")
    body = F.struct(
        F.when(nested, None).when((kind == "movement") & (seq % 11 == 0), "").when((kind != "movement") | (seq % 2 == 0), own).alias("train_id"),
        F.when((kind == "movement") & (seq % 2 == 1) & (seq % 11 != 0), own).alias("current_train_id"), F.when(nested, F.struct(own.alias("train_id"))).alias("train_info"),
        F.col("train_uid"), F.concat(F.lit("T"), (F.col("k") % 7).cast("string")).alias("toc_id"), _ms(F.col("event_at")).alias("event_timestamp"),
    )
    made = _frames(A.trust_events(spark, d), "trust", F.to_json(F.struct(F.struct(codes[kind].alias("msg_type")).alias("header"), body.alias("body"))), seq)
    rows = _children(frames.parse_trust(made), made).withColumn("seq", F.col("frame") * 10 + F.col("child_index") + 1)
    return records.trust_identities(rows).select("seq", "event_type", "train_id", "train_uid", "signalling_id", "operator_code")


def _vstp_frames(spark, d):
    """A frame per schedule; segments and calls are arrays or single objects, one in seven has a wrong indicator."""
    call = F.to_json(F.struct(F.struct(F.struct(F.col("tiploc").alias("tiploc_id")).alias("tiploc")).alias("location"), F.lit("TBT").alias("CIF_activity"), F.concat((F.col("seq_no") % 24).cast("string"), F.lit("00")).alias("scheduled_arrival_time")))
    listed = lambda calls: F.concat(F.lit("["), F.array_join(calls, ","), F.lit("]"))
    by = A.schedule_locations(spark, d).groupBy("schedule_id").agg(F.array_sort(F.collect_list(F.struct("seq_no", call.alias("j")))).alias("c"))
    rows = A.schedules(spark, d).join(by, "schedule_id", "left").withColumn("c", F.coalesce(F.col("c.j"), F.array().cast("array<string>")))
    segment = lambda calls: F.concat(F.lit('{"signalling_id":"'), F.col("train_uid"), F.lit('","schedule_location":'), calls, F.lit("}"))
    halves = F.concat(F.lit("["), segment(listed(F.slice("c", 1, 2))), F.lit(","), segment(listed(F.slice("c", F.lit(3), F.size("c")))), F.lit("]"))
    whole = segment(F.when(F.size("c") == 1, F.col("c")[0]).otherwise(listed(F.col("c"))))
    segments = F.when(F.col("schedule_id") % 2 == 0, halves).otherwise(whole)
    stp = F.when(F.col("schedule_id") % 7 == 3, "X").otherwise(F.col("stp"))
    head = F.to_json(F.struct(F.lit("Create").alias("transaction_type"), F.col("schedule_id").cast("string").alias("id"), F.col("train_uid").alias("CIF_train_uid"), F.col("start_date").cast("string").alias("schedule_start_date"), F.col("end_date").cast("string").alias("schedule_end_date"), stp.alias("CIF_stp_indicator"), F.col("days_run").alias("schedule_days_runs")))
    body = F.concat(F.lit('{"VSTPCIFMsgV1":{"schedule":'), F.expr("substring(_h, 1, length(_h) - 1)"), F.lit(',"schedule_segment":'), segments, F.lit("}}}"))
    return rows.withColumn("_h", head).select(F.lit("vstp").alias("feed_name"), body.alias("body"), F.lit("2026-01-01").cast("timestamp").alias("received_at"))


def _vstp(spark, d):
    rows = records.vstp_schedules(frames.parse_vstp(_vstp_frames(spark, d)))
    return rows.withColumn("schedule_id", F.get_json_object("raw_event", "$.VSTPCIFMsgV1.schedule.id").cast("long"))


@query("sch loc", "SELECT s.schedule_id, 'create' AS operation, s.train_uid, s.start_date, s.end_date, s.stp, s.days_run, s.train_uid AS signalling_id, (SELECT count(*) FROM loc l WHERE l.schedule_id=s.schedule_id) AS n_calls FROM sch s WHERE s.schedule_id%7<>3")
def flt_09_vstp_schedules(spark, d):
    return _vstp(spark, d).select("schedule_id", "operation", "train_uid", "start_date", "end_date", "stp", "days_run", "signalling_id", F.size("calls").cast("long").alias("n_calls"))


@query("sch loc", "SELECT schedule_id, CAST(seq_no AS INTEGER) AS seq_no, CASE WHEN seq_no=1 THEN 'origin' WHEN seq_no=n THEN 'destination' ELSE 'intermediate' END AS kind, tiploc, CAST(seq_no%24 AS VARCHAR)||'00' AS arrival_working, 'TB,T' AS codes FROM (SELECT *, count(*) OVER (PARTITION BY schedule_id) AS n FROM loc) JOIN sch USING (schedule_id) WHERE schedule_id%7<>3")
def flt_09_vstp_calls(spark, d):
    return records.vstp_calls(_vstp(spark, d), ["schedule_id"]).select("schedule_id", "seq_no", "kind", "tiploc", "arrival_working", F.array_join("activity_codes", ",").alias("codes"))


@query("tds", """SELECT seq, td_area, CASE WHEN seq%4=0 THEN 'SF_MSG' ELSE address END AS address, CASE WHEN seq%5<>0 THEN data ELSE
  '{"seq":"'||CAST(seq AS VARCHAR)||'","area_id":"'||td_area||'","time":"'||CAST(epoch_us(event_at)//1000 AS VARCHAR)||'"'||CASE WHEN seq%4=0 THEN '' ELSE ',"address":"'||address||'"' END||'}' END AS data FROM tds""")
def s_18_signals(spark, d):
    seq = F.col("seq")
    payload = F.struct(seq.cast("string").alias("seq"), F.col("td_area").alias("area_id"), _ms(F.col("event_at")).alias("time"), F.when(seq % 4 != 0, F.col("address")).alias("address"), F.when(seq % 5 != 0, F.col("data")).alias("data"))
    body = F.concat(F.lit("["), F.to_json(F.struct(payload.alias("SF_MSG"))), F.lit("]"))
    made = A.td_s_events(spark, d).select(F.lit("td").alias("feed_name"), body.alias("body"), F.col("event_at").cast("timestamp").alias("received_at"))
    rows = records.td_signals(frames.parse_td(made))
    return rows.select(F.get_json_object("raw_event", "$.SF_MSG.seq").cast("long").alias("seq"), "td_area", "address", "data")


@query("loc", """SELECT schedule_id, seq_no, seq_no%3<>0 AS is_call, CASE WHEN seq_no%3=0 THEN '1200' END AS pass_time, CASE seq_no%4 WHEN 0 THEN 'DM/FL' WHEN 1 THEN 'FL' WHEN 2 THEN 'DM' ELSE '' END AS path_line FROM loc""")
def s_21_calls_and_passes(spark, d):
    n, none = F.col("seq_no"), F.lit(None).cast("string")
    call, passed, line = text.call_or_pass(F.when(n % 3 == 1, "1000"), none, none, F.when(n % 3 == 2, "1100"), none, F.when(n % 3 == 0, "1200"), F.when(n % 4 == 0, "DM").when(n % 4 == 2, "DM").when(n % 4 == 1, ""), F.when(n % 4 <= 1, "FL"))
    return A.schedule_locations(spark, d).select("schedule_id", n.cast("long").alias("seq_no"), call.alias("is_call"), passed.alias("pass_time"), line.alias("path_line"))


def _driven(spark, d, twice=True):
    """Decisions known at a time, ten days before the last event, with the time ``now`` of the next run."""
    occ, (best, made) = berths.occupancies(A.td_events(spark, d)), _best(spark, d, twice=twice)
    last = A.td_events(spark, d).agg(F.max("event_at").alias("now"))
    known = resolver.decide_tops(best, "entered_at").join(F.broadcast(last), F.col("entered_at") <= F.col("now") - F.expr("INTERVAL 10 DAYS"))
    known = known.withColumnRenamed("entered_at", "decided_at")
    return occ.join(F.broadcast(last)), best, known, made


_NOW = "(SELECT max(event_at) FROM td)"
_DUE = f"""SELECT o.occupancy_id, CASE WHEN o.entered_at > {_NOW} - INTERVAL 10 DAY THEN 'new' ELSE 'retry' END AS phase FROM occ o JOIN decided x USING (occupancy_id)
  WHERE o.entered_at > {_NOW} - INTERVAL 10 DAY OR (o.exit_seq IS NULL AND x.status<>'matched' AND o.entered_at < {_NOW} - INTERVAL 5 MINUTE)"""


@query("td occ decided", _DUE)
def res_06_due(spark, d):
    occ, _, known, _ = _driven(spark, d, twice=False)
    return resolver.due(occ, known, F.col("now")).select("occupancy_id", "phase")


_SUPPORT = f"SELECT o.descr, o.td_area, o.entered_at, o.occupancy_id, NULL AS c, x.run_id AS known FROM occ o JOIN decided x USING (occupancy_id) WHERE x.status='matched' AND o.entered_at <= {_NOW} - INTERVAL 10 DAY"
VIEWS["walk_due"] = ("td occ decided", in_order(f"SELECT *, CAST(NULL AS VARCHAR) AS known FROM ({CANDIDATES}) WHERE occupancy_id IN (SELECT occupancy_id FROM ({_DUE})) UNION ALL {_SUPPORT}", "walk_due")[0])


@query("walk_due", f"""SELECT x.occupancy_id, CASE WHEN u.phase IS NULL THEN x.status ELSE coalesce(w.status,'unmatched') END AS status, CASE WHEN u.phase IS NULL THEN x.run_id ELSE w.run_id END AS run_id, CASE WHEN u.phase IS NULL THEN x.score ELSE coalesce(w.score,0) END AS score, u.phase IS NOT NULL AS decided_now
  FROM decided x LEFT JOIN ({_DUE}) u USING (occupancy_id) LEFT JOIN ({in_order("", "walk_due")[1]}) w USING (occupancy_id)""")
def res_06_driver(spark, d):
    occ, best, known, made = _driven(spark, d)
    mark = F.lit("9999-01-01").cast("timestamp_ntz")
    after = resolver.resolve_due(known.drop("now"), resolver.due(occ, known, F.col("now")), best, mark, known=occ.select("occupancy_id", "td_area", "descr", "entered_at"), facts=resolver.run_facts(*made))
    return after.select("occupancy_id", "status", "run_id", "score", (F.col("decided_at") == mark).alias("decided_now"))


@query("td", "SELECT seq, td_area, message_type FROM td WHERE seq > (SELECT max(seq)//2 FROM td) AND td_area='A1'")
def src_15_after_sequence(spark, d):
    log = A.td_events(spark, d)
    seen = log.agg(F.floor(F.max("seq") / 2).alias("seq")).first()["seq"] or 0
    return paging.after(log, "td_area", "A1", "seq", seen).select("seq", "td_area", "message_type")


@query("sch", f"""SELECT train_uid, stp, coalesce(min(schedule_id) FILTER (WHERE start_date < DATE '{DAY}'), min(schedule_id)) AS schedule_id FROM sch GROUP BY train_uid, stp HAVING max(start_date) >= DATE '{DAY}'""")
def snk_23_insert_or_get(spark, d):
    rows, day = A.schedules(spark, d), F.to_date(F.lit(DAY))
    first = rows.where(F.col("start_date") < day).groupBy("train_uid", "stp").agg(F.min("schedule_id").alias("schedule_id"))
    return tables.insert_or_get(first, rows.where(F.col("start_date") >= day), ["train_uid", "stp"], "schedule_id")


# Drafts


@query("cur", f"""SELECT i.map_id, i.element_id, c.descr, c.event_at, c.source_seq FROM (WITH {_ELEM} SELECT map_id, td_area, berth, max_by(element_id, pos) AS element_id FROM bnd WHERE type='tdBerth' GROUP BY 1,2,3) i LEFT JOIN cur c USING (td_area, berth)""")
def res_12_draft_state(spark, d):
    return maps.live_state(maps.binding_index(_document(spark, d)), berths.current_state(A.td_events(spark, d)))


def _versions(spark, d):
    """(slugs, versions, drafts): two versions of the maps of two regions, drafts of one of them and of another."""
    slugs = A.table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("slug"), "n_regionkey")
    text_of = lambda kind: F.concat(F.lit(kind), F.lit(" of "), F.col("slug"))
    both = slugs.where("n_regionkey in (0, 1)").withColumn("version", F.explode(F.array(F.lit(1), F.lit(2)))).select("slug", "version", text_of("version").alias("document"))
    drafts = slugs.where("n_regionkey in (1, 2)").select("slug", F.lit(7).alias("revision"), text_of("draft").alias("document"), F.when(F.col("n_regionkey") == 1, 1).alias("base_version"))
    return slugs, both, drafts


_BLANK = """'{"schemaVersion":1,"map":{"id":"'||slug||'","name":"'||slug||'","canvas":{"width":2000,"height":800,"gridSize":10},"timezone":"Europe/London"},"layers":[{"id":"layer-default","name":"Default","visible":true,"locked":false,"order":0}],"elements":[],"topology":{"nodes":[],"edges":[]},"bindings":[],"editorMetadata":{}}'"""
_SLUGS = "(SELECT 'n'||CAST(n_nationkey AS VARCHAR) AS slug, n_regionkey AS r FROM nation)"


@query("", f"""SELECT slug, CASE WHEN r IN (1,2) THEN 7 ELSE 1 END AS revision, CASE WHEN r IN (1,2) THEN 'draft of '||slug WHEN r=0 THEN 'version of '||slug ELSE {_BLANK} END AS document, CASE r WHEN 0 THEN 2 WHEN 1 THEN 1 END AS base_version FROM {_SLUGS}""")
def doc_09_seeded_drafts(spark, d):
    slugs, versions, drafts = _versions(spark, d)
    return maps.seeded_drafts(slugs, drafts, versions.where("version = 2"))


@query("", f"""SELECT slug, 1 AS from_version, t AS to_version, 'version of '||slug AS before, CASE WHEN t IS NULL THEN 'draft of '||slug ELSE 'version of '||slug END AS after FROM {_SLUGS}, (SELECT unnest([2, 3, NULL]) AS t) WHERE r IN (0,1) AND (t=2 OR (t IS NULL AND r=1))""")
def joi_24_diff_sides(spark, d):
    slugs, versions, drafts = _versions(spark, d)
    none = F.lit(None).cast("int")
    requests = slugs.select("slug", F.lit(1).alias("from_version"), F.explode(F.array(F.lit(2), F.lit(3), none)).alias("to_version"))
    return maps.diff_sides(requests, versions, drafts)


# Logs of attempts


_TRIES = "(SELECT CAST(o_custkey AS VARCHAR) AS slug, o_orderkey AS seq, o_orderkey%7=0 AS ok, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey%3=0 THEN 0 ELSE o_orderkey%4 END AS base FROM orders)"


def _tries(spark, d):
    key = F.col("o_orderkey")
    return A.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("slug"), key.alias("seq"), (key % 7 == 0).alias("ok"), F.to_date("o_orderdate").alias("day"), F.when(key % 3 == 0, 0).otherwise(key % 4).alias("base"))


@query("", f"""SELECT slug AS checksum, seq, CASE WHEN seq>min(CASE WHEN ok THEN seq END) OVER (PARTITION BY slug) THEN 'skipped' WHEN ok THEN 'completed' ELSE 'failed' END AS decision FROM {_TRIES}""")
def snk_22_import_decisions(spark, d):
    """Orders as attempts to import a customer's file; one in seven succeeds."""
    attempts = _tries(spark, d).select(F.lit("schedule").alias("source_kind"), F.col("slug").alias("checksum"), "seq", "ok")
    return imports.import_decisions(attempts).select("checksum", "seq", "decision")


@query("", f"""WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY seq) AS n FROM {_TRIES}),
w AS (SELECT DISTINCT slug, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS base_revision, false AS accepted, CAST(0 AS BIGINT) AS revision FROM t
  UNION ALL SELECT t.slug, t.n, t.seq, t.base, t.base=w.revision, w.revision+CAST(t.base=w.revision AS BIGINT) FROM w JOIN t ON t.slug=w.slug AND t.n=w.n+1) SELECT slug, seq, base_revision, accepted, revision FROM w WHERE n>0""")
def snk_20_accepted_saves(spark, d):
    """Orders as attempts to save a customer's draft from some revision."""
    return imports.accepted_saves(_tries(spark, d).select("slug", "seq", F.col("base").alias("base_revision")))


@query("", f"""SELECT slug, seq, CAST(row_number() OVER w AS INTEGER) AS version, day AS effective_from, lead(day) OVER w AS effective_to FROM (SELECT *, max(day) OVER (PARTITION BY slug ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM {_TRIES})
  WHERE latest IS NULL OR day>latest WINDOW w AS (PARTITION BY slug ORDER BY seq)""")
def snk_19_published_versions(spark, d):
    """Orders as requests to publish a version of a customer's map from a day on."""
    return maps.published(_tries(spark, d).select("slug", "seq", F.col("day").alias("effective_from")))
