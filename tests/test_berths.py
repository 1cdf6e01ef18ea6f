import random
from datetime import datetime, timedelta

from trackledger.operators import berths

T0 = datetime(2026, 1, 1)
SCHEMA = "seq long, event_at timestamp, td_area string, message_type string, from_berth string, to_berth string, descr string"


def log(seed):
    rng = random.Random(seed)
    names = [f"B{i}" for i in range(rng.randint(1, 6))]
    rows = []
    for seq in range(1, rng.randint(2, 80)):
        kind = rng.choice(["CA", "CA", "CB", "CC", "CT"])
        descr = rng.choice(["1A01", "2B02", "----"])
        rows.append((seq, T0 + timedelta(seconds=rng.randint(0, 500)), f"Z{seed}", kind, rng.choice(names), rng.choice(names), descr))
    return rows


def fold(rows):
    """One message after the other, as an operator at a panel would keep the berths."""
    held, occupied, wrong = {}, [], []

    def end(berth, at, seq, reason):
        if berth in held:
            o = held.pop(berth)
            o["left_at"], o["exit_seq"], o["exit_reason"] = at, seq, reason

    def check(berth, before, descr, seq):
        if descr != "----" and before != descr:
            wrong.append((seq, berth, before, "from_berth_empty" if before is None else "from_berth_description_mismatch"))

    for seq, at, area, kind, a, b, descr in rows:
        if kind in ("CA", "CB"):
            check(a, held[a]["descr"] if a in held else None, descr, seq)
            if not (kind == "CA" and a == b):
                end(a, at, seq, "cancelled" if kind == "CB" else "stepped_out")
        if kind in ("CA", "CC"):
            end(b, at, seq, "overwritten_by_step" if kind == "CA" else "overwritten_by_interpose")
            if descr != "----":
                held[b] = {"berth": b, "descr": descr, "id": seq, "entered_at": at, "left_at": None, "exit_seq": None, "exit_reason": None}
                occupied.append(held[b])
    return occupied, wrong, held


def test_windows_equal_a_sequential_fold(spark):
    rows, want, bad, open_now = [], set(), set(), set()
    for seed in range(60):
        own = log(seed)
        rows += own
        occupied, wrong, held = fold(own)
        want |= {(f"Z{seed}", o["berth"], o["descr"], o["id"], o["entered_at"], o["left_at"], o["exit_seq"], o["exit_reason"]) for o in occupied}
        bad |= {(f"Z{seed}", *w) for w in wrong}
        open_now |= {(f"Z{seed}", b, o["descr"]) for b, o in held.items()}
    events = spark.createDataFrame(rows, SCHEMA)
    got = {(r.td_area, r.berth, r.descr, r.occupancy_id, r.entered_at, r.left_at, r.exit_seq, r.exit_reason) for r in berths.occupancies(events).collect()}
    assert got == want
    assert {(r.td_area, r.seq, r.berth, r.found, r.code) for r in berths.anomalies(events).collect()} == bad
    assert {(r.td_area, r.berth, r.descr) for r in berths.current_state(events).where("descr is not null").collect()} == open_now


def test_no_events_and_heartbeats_only(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert berths.occupancies(empty).count() == berths.current_state(empty).count() == 0
    ct = spark.createDataFrame([(1, T0, "ZZ", "CT", None, None, None)] * 2, SCHEMA)
    assert berths.touches(ct).count() == 0 and berths.heartbeats(ct).count() == 1


def test_clears_end_an_occupancy_in_the_live_view_only(spark):
    events = spark.createDataFrame([(1, T0, "ZZ", "CC", None, "0001", "1A01")], SCHEMA)
    clears = spark.createDataFrame([(2, T0, "ZZ", "0001")], "seq long, event_at timestamp, td_area string, berth string")
    live = berths._with_states(berths.with_clears(events, clears)).where("opens").collect()
    assert live[0]["_next"]["reason"] == "manual_operator_clear"
    assert berths.occupancies(events).first().left_at is None


def test_clears_leave_an_audit_row_and_need_a_reason(spark):
    events = spark.createDataFrame([(1, T0, "ZZ", "CC", None, "0001", "1A01"), (5, T0, "ZZ", "CC", None, "0001", "2B02")], SCHEMA)
    asked = [(2, T0, "ZZ", "0001", " stuck "), (3, T0, "ZZ", "0001", "again"), (6, T0, "ZZ", "0009", "empty"), (7, T0, "ZZ", "0001", " "), (8, T0, "ZZ", "0001", None)]
    clears, refused = berths.valid_clears(spark.createDataFrame(asked, "seq long, event_at timestamp, td_area string, berth string, reason string"))
    got = {r.seq: (r.reason, r.closed_occupancy_id, r.closed_entered_at, r.previous_descr) for r in berths.clear_actions(events, clears).collect()}
    assert got == {2: ("stuck", 1, T0, "1A01"), 3: ("again", None, None, None), 6: ("empty", None, None, None)}
    assert {r.seq for r in refused.collect()} == {7, 8}
