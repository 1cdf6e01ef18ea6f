"""A selection of the registered queries against their SQL."""

import math
import os

import duckdb
import pytest

from trackledger.plans import ALL_ORACLES, ALL_QUERIES, records

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = ["red_05_occupancies", "red_09_13_runs", "red_15_run_schedule_links", "res_03_resolution", "src_06_td_children", "src_07_trust_children", "doc_02_issues", "doc_03_unobserved_bindings", "agg_09_element_counts", "joi_15_set_02_never_observed", "joi_10_open_versions", "snk_04_insert_or_ignore", "flt_06_joi_01_wanted_berths", "str_07_win_08_poll_deltas", "doc_05_agg_11_adjacency", "joi_22_doc_11_reconcile", "str_09_snapshot_and_deltas", "snk_05_upsert", "s_01_normalized_times", "joi_19_current_runs", "srt_10_joi_18_routes", "res_07_run_summaries", "red_12_runs_with_changes", "red_12_run_events_with_changes", "red_12_skipped_with_changes", "red_12_resolution_with_changes", "res_05_resolution_in_order", "agg_04_binding_diagnostics", "doc_03_info", "res_11_definition_at", "res_11_map_status", "snk_18_clear_actions", "joi_14_staged_children", "red_05_occupancies_in_segments", "flt_01_week_of_a_stored_history", "src_04_replayed_fixtures", "snk_11_str_08_topics", "snk_09_tombstones", "snk_16_rebuilt_projection", "src_09_schedule_lines", "flt_10_schedules_of_files", "flt_10_unhandled_records", "flt_14_complete_files", "src_10_locations", "src_11_berth_steps", "src_13_src_14_archived_objects", "src_16_doc_01_documents_of_files", *records.QUERIES]


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        if file.endswith(".parquet"):
            con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{SF}/{file}'")
    want = con.execute(ALL_ORACLES[name])
    columns = [c[0] for c in want.description]
    got = ALL_QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    rows = [tuple(plain(v) for v in row) for row in want.fetchall()]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(plain(v) for v in row)) for row in got.select(*columns).collect())


def test_every_sql_belongs_to_a_query():
    assert set(ALL_ORACLES) <= set(ALL_QUERIES)
