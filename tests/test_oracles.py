"""Registered queries against their SQL on the smallest supplied tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from compare import compare, duck  # noqa: E402

from bladewatch.catalog import all_queries, all_sql  # noqa: E402

# One or two queries per family keep the suite short; tools/compare.py runs all of them.
SAMPLED = (
    "p6_quality_report", "e2_test_rul", "a3_sensor_statistics", "a7_healthy_baseline", "m2_regime_normalised",
    "w2_rolling_std", "e10_explain_anomalies", "e33_what_if", "e27_cost_analysis", "a11_engine_summary",
    "a15_priority_ranking", "r2_current_work_orders", "v14_anomalous_spans", "j10_detection_latency",
    "a17_interval_calibration", "a19_horizon_summary", "s1_raw_telemetry_text", "s2_true_rul_text",
    "t1_stream_scoring", "t2_stream_rolling_features", "t3_stream_anomaly_rate",
)


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", SAMPLED)
def test_query_matches_sql(spark, con, sf, name):
    ok, note = compare(spark, con, name, all_queries()[name], all_sql()[name], sf)
    assert ok, note


def test_every_sql_has_a_query():
    assert set(all_sql()) <= set(all_queries())
