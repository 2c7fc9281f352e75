"""Threshold boundaries and texts, on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from bladewatch.functions import accuracy, advice, anomaly, economics, health
from bladewatch.operators import advisory


def status(spark, rows):
    df = spark.createDataFrame(rows, "rul double, a double, label string, want string")
    got = df.select("rul", "a", "want", health.health_status(F.col("rul"), F.col("a"), F.col("label")).alias("d"))
    return [(r.rul, r.a, r.d.status, r.want) for r in got.collect()]


def test_health_status_boundaries(spark):
    rows = [
        (60.0, 75.0, "Normal", "UNKNOWN BEHAVIOUR"), (59.99, 75.0, "Normal", "MAINTENANCE REQUIRED"),
        (60.0, 80.0, "Normal", "UNKNOWN BEHAVIOUR"), (70.0, 65.0, "Normal", "MODEL DISAGREEMENT"),
        (69.99, 65.0, "Normal", "MAINTENANCE REQUIRED"), (20.0, 30.0, "Normal", "MODEL DISAGREEMENT"),
        (20.0, 30.01, "Normal", "MAINTENANCE REQUIRED"), (19.99, 31.0, "Normal", "CRITICAL"),
        (30.0, 80.0, "Normal", "CRITICAL"), (30.0, 79.99, "Normal", "MAINTENANCE REQUIRED"),
        (44.99, 40.0, "Normal", "MAINTENANCE REQUIRED"), (45.0, 40.0, "Normal", "MONITOR"),
        (74.99, 10.0, "Normal", "MONITOR"), (75.0, 44.99, "Normal", "HEALTHY"), (75.0, 45.0, "Normal", "MONITOR"),
        (100.0, 10.0, " Anomalous ", "MONITOR"), (100.0, 10.0, "Normal", "HEALTHY"),
    ]
    for rul, a, got, want in status(spark, rows):
        assert got == want, (rul, a)


def test_limits_can_be_overridden(spark):
    df = spark.createDataFrame([(30.0, 40.0)], "rul double, a double")
    got = df.select(health.health_status(F.col("rul"), F.col("a"), limits={"critical_rul": 35.0})["status"]).first()[0]
    assert got == "CRITICAL"


def test_scores_and_range(spark):
    df = spark.createDataFrame([(50.0, 40.0)], "r double, a double")
    low, high = health.rul_range(F.col("r"))
    row = df.select(health.composite_score(F.col("r"), F.col("a")), low, high,
                    health.confidence(F.col("r"), F.col("a")), health.health_score(F.col("r"), mode="exponential"),
                    health.priority_index(F.lit(48.0), F.col("a"))).first()
    assert row[0] == 48.0 and row[1] == 44.0 and row[2] == 56.0 and row[3] == 86.0
    assert row[4] == pytest.approx(100 * (1 - math.exp(-50 / 62.5)) / (1 - math.exp(-2)))
    assert row[5] == 64.0


def test_urgency_windows(spark):
    rows = [("CRITICAL", 10.0, 0), ("MAINTENANCE REQUIRED", 5.0, 1), ("MAINTENANCE REQUIRED", 12.9, 7),
            ("MAINTENANCE REQUIRED", 44.0, 15), ("MONITOR", 15.0, 5), ("MONITOR", 40.5, 25), ("MONITOR", 70.0, 30),
            ("HEALTHY", 90.0, -1), ("UNKNOWN BEHAVIOUR", 90.0, -1)]
    df = spark.createDataFrame(rows, "s string, r double, want int")
    for r in df.withColumn("got", advice.urgency_window(F.col("s"), F.col("r"))).collect():
        assert r.got == r.want, r


@pytest.mark.parametrize("text,components,systems", [
    ("", ["All Subsystems Nominal"], ["Nominal"]),
    ("None", ["All Subsystems Nominal"], ["Nominal"]),
    ("All sensors within nominal range", ["All Subsystems Nominal"], ["Nominal"]),
    ("vibration", ["General Telemetry"], ["General Engine Health"]),
    ("sensor_99 (+3.00σ)", ["General Subsystems"], ["Core Gas Path"]),
    ("sensor_11 (+3.4σ) | sensor_3 (+2σ) | sensor_7 (-2σ)",
     ["High-Pressure Turbine (HPT)", "High-Pressure Compressor (HPC)"], ["Turbine Gas Path", "Compression"]),
])
def test_targets(spark, text, components, systems):
    row = advice.with_targets(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert (row.components, row.systems) == (components, systems)


def test_subsystem_first_match_and_exact(spark):
    df = spark.createDataFrame([("sensor_11 high",), ("Ps30 low",), ("quiet",)], "t string")
    plain = [r[0] for r in df.select(advice.subsystem_of(F.col("t"))).collect()]
    exact = [r[0] for r in df.select(advice.subsystem_of(F.col("t"), True)).collect()]
    assert plain == ["Air Intake", "Combustion", "Compressor"]
    assert exact == ["Turbine", "Combustion", "Compressor"]


def test_reason_and_actions(spark):
    df = spark.createDataFrame(
        [(10.0, 85.0, "Anomalous", "sensor_3 (+3.10σ, Critical deviation)")],
        "predicted_RUL double, anomaly_score double, anomaly_label string, top_abnormal_sensors string")
    row = advisory.recommend(advisory.assess(df)).first()
    assert row.decision_reason == (
        "CRITICAL: Imminent end-of-life (RUL: 10.0 cycles) combined with severe multi-sensor anomaly (Score: 85.0/100)"
        " | Sensor deviations: sensor_3 (+3.10σ, Critical deviation).")
    assert row.targeted_action_items.startswith("IMMEDIATE GROUNDING") and "HPC stages 5-9" in row.targeted_action_items
    assert row.impacted_components == "High-Pressure Compressor (HPC)" and row.urgency_window_cycles == 0


def test_risk_matrix_and_costs(spark):
    df = spark.createDataFrame([(30.0, 10.0)], "r double, a double")
    p = economics.failure_probability(F.col("r"), F.col("a"))
    row = df.select(p, economics.likelihood_name(p), economics.severity_name(
        economics.severity_level(F.lit("high"), F.lit("CRITICAL")))).first()
    assert tuple(row) == (0.5, "Probable", "Catastrophic")
    cost = df.select(*[c.alias(n) for n, c in economics.cost_columns(F.col("r"), p, F.lit(12.0)).items()]).first()
    assert cost.labour_cost == 2220 and cost.planned_intervention_cost == 152220
    assert cost.unplanned_event_cost == 779500 and cost.expected_saving == 0.5 * 779500 + 75000 - 152220


def test_bins_severity_and_penalty(spark):
    df = spark.createDataFrame([(19.99,), (20.0,), (40.0,), (70.0,), (100.0,), (300.0,)], "p double")
    assert [r[0] for r in df.select(accuracy.rul_bin(F.col("p"))).collect()] == [0, 1, 2, 3, 4, 4]
    got = df.select(anomaly.anomaly_severity(F.lit(79.99)), anomaly.anomaly_severity(F.lit(80.0)),
                    accuracy.nasa_penalty(F.lit(10.0), F.lit(0.0)), accuracy.nasa_penalty(F.lit(0.0), F.lit(10.0))
                    ).first()
    assert got[0] == "Moderate Anomaly" and got[1] == "Severe Anomaly"
    assert got[2] == pytest.approx(math.exp(10 / 13) - 1) and got[3] == pytest.approx(math.e - 1)
