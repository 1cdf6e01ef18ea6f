"""The test views in SQL, for comparison with the DataFrame operators."""

from __future__ import annotations

_HEAD = "CAST(user_id%5+1 AS VARCHAR)||chr(CAST(65+user_id%3 AS INTEGER))||'0'||CAST(user_id%2 AS VARCHAR)"

VIEWS = {
    "ev": ("", "SELECT *, CAST(json_extract_string(props,'$.k') AS INTEGER) AS k FROM events"),
    "td": (
        "ev",
        f"""SELECT event_id+1 AS seq, ts AS event_at, 'A'||CAST(user_id%5 AS VARCHAR) AS td_area,
      CASE event_type WHEN 'click' THEN 'CA' WHEN 'signup' THEN 'CA' WHEN 'view' THEN 'CC' WHEN 'purchase' THEN 'CB' WHEN 'error' THEN 'CT' END AS message_type,
      lpad(CAST(k%12 AS VARCHAR),4,'0') AS from_berth, lpad(CAST((k+1+event_id%3)%12 AS VARCHAR),4,'0') AS to_berth,
      CASE WHEN event_id%17=0 THEN '----' ELSE {_HEAD} END AS descr FROM ev""",
    ),
    "tds": ("ev", "SELECT event_id+1 AS seq, ts AS event_at, 'A'||CAST(user_id%5 AS VARCHAR) AS td_area, 'A'||CAST(k%8 AS VARCHAR) AS address, upper(to_hex(k)) AS data FROM ev WHERE event_type='error'"),
    "tr": (
        "ev",
        f"""SELECT event_id+1 AS seq, ts AS event_at, user_id AS identity,
      CASE WHEN event_type='signup' THEN 'activation' WHEN event_type='error' THEN 'cancellation' WHEN event_type='purchase' THEN 'reinstatement' WHEN event_type='view' AND k%6=0 THEN 'unidentified' ELSE 'movement' END AS event_type,
      CAST(ts - INTERVAL 3 HOUR AS DATE) AS service_date, {_HEAD} AS signalling_id, 'U'||CAST(user_id%200 AS VARCHAR) AS train_uid, value, k FROM ev""",
    ),
    "tch": (
        "td",
        """SELECT seq, event_at, td_area, message_type, descr, from_berth AS berth, 'from' AS half, false AS opens,
      CASE message_type WHEN 'CB' THEN 'cancelled' ELSE 'stepped_out' END AS reason, descr<>'----' AS checked
      FROM td WHERE message_type='CB' OR (message_type='CA' AND from_berth<>to_berth)
      UNION ALL SELECT seq, event_at, td_area, message_type, descr, to_berth, 'to', descr<>'----',
      CASE message_type WHEN 'CA' THEN 'overwritten_by_step' ELSE 'overwritten_by_interpose' END,
      descr<>'----' AND message_type='CA' AND from_berth=to_berth FROM td WHERE message_type IN ('CA','CC')""",
    ),
    "st": (
        "tch",
        """SELECT *, lag(CASE WHEN opens THEN descr END) OVER w AS before, lead(event_at) OVER w AS left_at, lead(seq) OVER w AS exit_seq, lead(reason) OVER w AS exit_reason
      FROM tch WINDOW w AS (PARTITION BY td_area, berth ORDER BY seq)""",
    ),
    "occ": (
        "st",
        """SELECT seq AS occupancy_id, td_area, berth, descr, event_at AS entered_at,
      CASE message_type WHEN 'CA' THEN 'ca_step' ELSE 'cc_interpose' END AS entry_type, left_at, exit_seq, exit_reason FROM st WHERE opens""",
    ),
    "cur": (
        "occ",
        """SELECT td_area, berth, CASE WHEN exit_seq IS NULL THEN descr END AS descr, coalesce(left_at, entered_at) AS event_at,
      coalesce(exit_seq, occupancy_id) AS source_seq FROM (SELECT *, row_number() OVER (PARTITION BY td_area, berth ORDER BY occupancy_id DESC) AS n FROM occ) WHERE n=1""",
    ),
    "marked": ("tr", "SELECT *, min(CASE WHEN event_type IN ('activation','unidentified') THEN seq END) OVER (PARTITION BY identity, service_date) AS created_seq FROM tr"),
    "runs": (
        "marked",
        """SELECT identity, service_date, CAST(identity AS VARCHAR)||'|'||CAST(service_date AS VARCHAR) AS run_id, min(CASE WHEN seq=created_seq AND event_type='activation' THEN signalling_id END) AS signalling_id,
      min(CASE WHEN seq=created_seq AND event_type='activation' THEN train_uid END) AS train_uid,
      max_by(CASE event_type WHEN 'cancellation' THEN 'cancelled' WHEN 'unidentified' THEN 'unidentified' ELSE 'activated' END, seq) FILTER (WHERE event_type IN ('cancellation','reinstatement') OR seq=created_seq) AS state,
      min(created_seq) AS created_seq, min(CASE WHEN seq=created_seq AND event_type='activation' THEN event_at END) AS activated_at, max_by(event_at, seq) AS last_event_at, count(*) AS n_events
      FROM marked WHERE seq>=created_seq AND NOT (event_type='activation' AND seq>created_seq) GROUP BY identity, service_date""",
    ),
    "sch": (
        "",
        """SELECT o_orderkey AS schedule_id, 'U'||CAST(o_custkey%200 AS VARCHAR) AS train_uid, CAST(o_orderdate AS DATE) AS start_date,
      CAST(CAST(o_orderdate AS DATE)+CAST(30+o_orderkey%60 AS INTEGER) AS DATE) AS end_date, substr('PNOC',CAST(o_orderkey%4+1 AS INTEGER),1) AS stp,
      CASE WHEN o_orderkey%5<>0 THEN CAST(o_orderkey&1 AS VARCHAR)||CAST((o_orderkey>>1)&1 AS VARCHAR)||CAST((o_orderkey>>2)&1 AS VARCHAR)||CAST((o_orderkey>>3)&1 AS VARCHAR)||CAST((o_orderkey>>4)&1 AS VARCHAR)||CAST((o_orderkey>>5)&1 AS VARCHAR)||CAST((o_orderkey>>6)&1 AS VARCHAR) END AS days_run FROM orders""",
    ),
    "schs": ("sch", "SELECT schedule_id, train_uid, CAST(start_date+9000 AS DATE) AS start_date, CAST(end_date+9000 AS DATE) AS end_date, stp, days_run FROM sch"),
    "loc": (
        "",
        """SELECT l_orderkey AS schedule_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS seq_no,
      'L'||CAST(l_suppkey AS VARCHAR) AS tiploc FROM lineitem""",
    ),
    "ref": ("", "SELECT 'L'||CAST(s_suppkey AS VARCHAR) AS tiploc, 'S'||CAST(s_nationkey AS VARCHAR) AS stanox, s_name AS name FROM supplier"),
    "smart": ("", "SELECT 'A'||CAST(c//12 AS VARCHAR) AS td_area, lpad(CAST(c%12 AS VARCHAR),4,'0') AS to_berth, 'S'||CAST(c%25 AS VARCHAR) AS stanox FROM (SELECT unnest(range(60)) AS c)"),
    "bind": (
        "",
        """SELECT CASE WHEN c%2=0 THEN 'north' ELSE 'south' END AS slug, 'e-A'||CAST(c//12 AS VARCHAR)||'-'||lpad(CAST(c%12 AS VARCHAR),4,'0') AS element_id,
      'A'||CAST(c//12 AS VARCHAR) AS td_area, lpad(CAST(c%12 AS VARCHAR),4,'0') AS berth FROM (SELECT unnest(range(72)) AS c) WHERE c%12<=8""",
    ),
    "lcand": (
        "runs schs",
        """SELECT r.run_id, s.schedule_id, CASE s.stp WHEN 'C' THEN 4 WHEN 'O' THEN 3 WHEN 'N' THEN 2 ELSE 1 END AS rk FROM runs r JOIN schs s USING (train_uid)
      WHERE r.service_date BETWEEN s.start_date AND s.end_date AND (coalesce(s.days_run,'')='' OR substr(s.days_run, CAST(isodow(r.service_date) AS INTEGER),1)='1')""",
    ),
    "link": (
        "runs lcand",
        """SELECT r.run_id, CASE WHEN t.n IS NULL THEN 'unmatched' WHEN t.n=1 THEN 'matched' ELSE 'ambiguous' END AS outcome, CASE WHEN t.n=1 THEN t.schedule_id END AS schedule_id
      FROM runs r LEFT JOIN (SELECT run_id, count(*) AS n, min(schedule_id) AS schedule_id FROM (SELECT *, rank() OVER (PARTITION BY run_id ORDER BY rk DESC) AS x FROM lcand) WHERE x=1 GROUP BY run_id) t USING (run_id)""",
    ),
    "touching": ("loc ref smart", "SELECT DISTINCT l.schedule_id, s.td_area, s.to_berth AS berth FROM loc l JOIN ref r USING (tiploc) JOIN smart s USING (stanox)"),
    "cand": (
        "occ runs link touching",
        """SELECT o.occupancy_id, o.td_area, o.berth, o.descr, o.entered_at, r.run_id, r.activated_at, k.schedule_id IS NOT NULL AS linked,
      o.entered_at BETWEEN r.activated_at AND r.activated_at + INTERVAL 24 HOUR AS plausible, t.schedule_id IS NOT NULL AS stanox
      FROM occ o JOIN runs r ON o.descr=r.signalling_id AND r.service_date=CAST(o.entered_at - INTERVAL 3 HOUR AS DATE)
      LEFT JOIN link k ON k.run_id=r.run_id AND k.outcome='matched' LEFT JOIN touching t ON t.schedule_id=k.schedule_id AND t.td_area=o.td_area AND t.berth=o.berth""",
    ),
    "scored": ("cand", "SELECT *, CAST(40*CAST(linked AS INTEGER)+35*CAST(plausible AS INTEGER)+25*CAST(stanox AS INTEGER) AS INTEGER) AS score FROM cand"),
    "decided": (
        "occ scored",
        """SELECT o.occupancy_id, CASE WHEN b.score IS NULL OR b.score<=0 THEN 'unmatched' WHEN b.n>1 THEN 'ambiguous' ELSE 'matched' END AS status,
      CASE WHEN b.score>0 AND b.n=1 THEN b.run_id END AS run_id, coalesce(b.score,0) AS score, round(coalesce(b.score,0)/130.0,6) AS confidence, coalesce(b.total,0) AS n_candidates
      FROM occ o LEFT JOIN (SELECT occupancy_id, score, count(*) AS n, min(run_id) AS run_id, any_value(total) AS total FROM (SELECT *, rank() OVER (PARTITION BY occupancy_id ORDER BY score DESC) AS x,
      count(*) OVER (PARTITION BY occupancy_id) AS total FROM scored) WHERE x=1 GROUP BY occupancy_id, score) b USING (occupancy_id)""",
    ),
}


#: Events of which some change an identity, and the runs that follow from them.
VIEWS |= {
    "trc": ("tr", "SELECT * REPLACE (CASE WHEN k%9=0 THEN 'change_of_identity' ELSE event_type END AS event_type), CASE WHEN k%9=0 THEN (identity*7+3)%150 END AS revised_identity FROM tr"),
    "made": (
        "trc",
        """SELECT service_date, identity, min(seq) AS seq, CAST(NULL AS BIGINT) AS parent FROM trc WHERE event_type IN ('activation','unidentified') GROUP BY service_date, identity
      UNION SELECT c.service_date, c.revised_identity, c.seq, c.identity FROM made m JOIN trc c ON c.service_date=m.service_date AND c.identity=m.identity WHERE c.event_type='change_of_identity' AND c.seq>m.seq""",
    ),
    "born": ("made", "SELECT service_date, identity, seq AS created_seq, parent FROM (SELECT *, row_number() OVER (PARTITION BY service_date, identity ORDER BY seq) AS n FROM made) WHERE n=1"),
    "trail": (
        "born",
        """SELECT service_date, identity, identity AS root_identity FROM born WHERE parent IS NULL
      UNION ALL SELECT b.service_date, b.identity, t.root_identity FROM trail t JOIN born b ON b.service_date=t.service_date AND b.parent=t.identity""",
    ),
    "chg": ("trc born", "SELECT c.*, b.created_seq AS old_seq FROM trc c JOIN born b USING (service_date, identity) WHERE c.event_type='change_of_identity' AND c.seq>b.created_seq"),
    "own": ("trc born", "SELECT e.*, b.created_seq FROM trc e JOIN born b USING (service_date, identity) WHERE e.event_type<>'change_of_identity' AND e.seq>=b.created_seq AND NOT (e.event_type='activation' AND e.seq>b.created_seq)"),
    "runs_c": (
        "own chg born trail",
        """SELECT b.identity, b.service_date, CAST(b.identity AS VARCHAR)||'|'||CAST(b.service_date AS VARCHAR) AS run_id, t.root_identity, r.signalling_id, a.train_uid, m.state, b.created_seq, a.event_at AS activated_at, m.last_event_at, m.n_events, m.superseded_by
      FROM born b JOIN trail t USING (service_date, identity)
      LEFT JOIN own a ON a.service_date=b.service_date AND a.identity=b.identity AND a.seq=b.created_seq AND a.event_type='activation'
      LEFT JOIN own r ON r.service_date=b.service_date AND r.identity=t.root_identity AND r.seq=r.created_seq AND r.event_type='activation'
      JOIN (SELECT service_date, identity, max_by(state, seq) FILTER (WHERE state IS NOT NULL) AS state, max_by(event_at, seq) AS last_event_at, count(*) FILTER (WHERE counts) AS n_events, max_by(superseded_by, seq) FILTER (WHERE superseded_by IS NOT NULL) AS superseded_by FROM (
        SELECT service_date, identity, seq, event_at, CASE WHEN event_type='cancellation' THEN 'cancelled' WHEN event_type='reinstatement' THEN 'activated' WHEN seq=created_seq THEN CASE event_type WHEN 'unidentified' THEN 'unidentified' ELSE 'activated' END END AS state, true AS counts, CAST(NULL AS BIGINT) AS superseded_by FROM own
        UNION ALL SELECT c.service_date, c.revised_identity, c.seq, c.event_at, CASE WHEN c.seq=b.created_seq THEN 'activated' END, true, NULL FROM chg c JOIN born b ON b.service_date=c.service_date AND b.identity=c.revised_identity
        UNION ALL SELECT service_date, identity, seq, event_at, 'superseded', false, revised_identity FROM chg) GROUP BY 1,2) m ON m.service_date=b.service_date AND m.identity=b.identity""",
    ),
}
for _name in ("lcand", "link", "cand", "scored", "decided"):  # the same over these runs
    _needs, _text = VIEWS[_name]
    for _old in ("runs", "lcand", "link", "cand", "scored"):
        _needs = " ".join(f"{n}_c" if n == _old else n for n in _needs.split())
        _text = _text.replace(f"FROM {_old} ", f"FROM {_old}_c ").replace(f"JOIN {_old} ", f"JOIN {_old}_c ").replace(f"FROM {_old})", f"FROM {_old}_c)")
        _text = f"{_text}_c" if _text.endswith(f"FROM {_old}") else _text
    VIEWS[f"{_name}_c"] = (_needs, _text if _name != "cand" else _text.replace("r.service_date=CAST", "r.state<>'superseded' AND r.service_date=CAST"))




def in_order(rows: str, walk: str = "walk") -> tuple[str, str]:
    """(recursive view, its select) that decides rows (descr, td_area, entered_at, occupancy_id, c: candidates, known: a match that stays) one after the other."""
    seqd = f"SELECT *, row_number() OVER (PARTITION BY descr, td_area ORDER BY entered_at, occupancy_id) AS n FROM ({rows})"
    near = f"SELECT s.*, w.last_run, w.last_at, coalesce(w.last_at < s.entered_at AND s.entered_at <= w.last_at + INTERVAL 10 MINUTE, false) AS near FROM {walk} w JOIN ({seqd}) s ON s.descr=w.descr AND s.td_area=w.td_area AND s.n=w.n+1"
    began = f"SELECT *, CASE WHEN near THEN list_filter(c, lambda x: x.run_id=last_run)[1].activated_at END AS began FROM ({near})"
    fresher = f"SELECT *, began IS NOT NULL AND len(list_filter(c, lambda x: x.run_id<>last_run AND x.activated_at>began))>0 AS fresher FROM ({began})"
    scores = f"SELECT *, list_transform(c, lambda x: x.score+CASE WHEN near AND NOT fresher AND x.run_id=last_run THEN 30 ELSE 0 END) AS s FROM ({fresher})"
    tops = f"SELECT *, coalesce(list_max(s),0) AS top FROM ({scores})"
    won = f"SELECT *, CASE WHEN top>0 AND len(list_filter(s, lambda x: x=top))=1 THEN c[list_position(s, top)].run_id END AS winner FROM ({tops})"
    return (
        f"""SELECT DISTINCT descr, td_area, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS occupancy_id, true AS fixed, CAST(0 AS BIGINT) AS top, CAST(0 AS BIGINT) AS n_candidates, CAST(NULL AS VARCHAR) AS winner, CAST(NULL AS VARCHAR) AS last_run, CAST(NULL AS TIMESTAMP) AS last_at FROM ({rows})
      UNION ALL SELECT descr, td_area, n, occupancy_id, known IS NOT NULL, top, coalesce(len(c),0), winner, coalesce(known, winner, last_run), CASE WHEN coalesce(known, winner) IS NOT NULL THEN entered_at ELSE last_at END FROM ({won})""",
        f"SELECT occupancy_id, CASE WHEN top<=0 THEN 'unmatched' WHEN winner IS NULL THEN 'ambiguous' ELSE 'matched' END AS status, winner AS run_id, CAST(top AS INTEGER) AS score FROM {walk} WHERE NOT fixed",
    )


CANDIDATES = "SELECT descr, td_area, entered_at, occupancy_id, list({'run_id': run_id, 'activated_at': activated_at, 'score': score} ORDER BY run_id) AS c FROM scored GROUP BY ALL"
VIEWS["walk"] = ("scored", in_order(f"SELECT *, CAST(NULL AS VARCHAR) AS known FROM ({CANDIDATES})")[0])
WALKED = in_order("")[1]

#: Views that name themselves.
RECURSIVE = {"made", "trail", "walk", "walk_due"}


def upto(interval: str, views: str, select: str) -> str:
    """The same over the events up to an interval before the last one, as a subquery."""
    return "(" + over(views, select).replace("FROM events", f"FROM events WHERE ts<=(SELECT max(ts) FROM events)-INTERVAL {interval}") + ")"


def over(views: str, select: str) -> str:
    """The select with the views it names, and those they need, in front."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in VIEWS[name][0].split():
            need(other)
        if name not in order:
            order.append(name)

    for name in views.split():
        need(name)
    return ("WITH " + ("RECURSIVE " if RECURSIVE & {*order} else "") + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order) + "\n" if order else "") + select
