"""Queries that group or order, with every group treated as a huge one."""

import pytest
from oracle import compare, connect, forbidden_joins

import __spark_entry__ as entry
from flowloom.operators import skew

SF = "/root/testdata/sf0.001"
NAMES = (
    "prepared_table",
    "rolling_uri_deviation",
    "same_ip_minute_counts",
    "level1_flow_flags",
    "chunked_level1_flags",
    "detect_alerts",
    "suppressed_alerts",
    "suppressed_out_of_order",
    "flow_locations",
    "packet_scores_on_flows",
    "plaintext_on_flows",
    "direction_matched_packets",
    "alert_map_positions",
    "incident_action_log",
    "alerts_with_incidents",
    "global_sequence_windows",
    "source_sequence_windows",
    "error_threshold",
    "training_slice",
    "positional_split",
    "category_indexes",
    "retention_marks",
    "flow_csv",
)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_when_split(spark, con, name, monkeypatch):
    monkeypatch.setattr(skew, "GROUP_LIMIT", 40)
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 1000)
    df = entry.queries()[name](spark, SF)
    assert compare(df, con, entry.oracle_sql()[name]) is None
    assert forbidden_joins(df) == []
