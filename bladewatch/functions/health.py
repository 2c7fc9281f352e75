"""Health score, health status and decision columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from bladewatch import constants as C
from bladewatch.functions.numeric import clip, half_even, one_decimal, pick


def health_score(rul: Column, baseline: float = C.RUL_CAP, mode: str = "piecewise_linear") -> Column:
    if mode == "piecewise_linear":
        raw = rul / F.lit(float(baseline)) * F.lit(100.0)
    elif mode == "exponential":
        tau = baseline / 2.0
        top = 1.0 - math.exp(-baseline / tau)
        raw = F.lit(100.0) * (F.lit(1.0) - F.exp(-rul / F.lit(tau))) / F.lit(top)
    else:
        raise ValueError(f"unknown health score mode {mode!r}")
    return clip(raw, 0.0, 100.0)


def health_stage(score: Column) -> Column:
    return pick(C.HEALTH_STAGES, score)


def is_flagged(label: Column) -> Column:
    return F.lower(F.trim(label)).isin("anomalous", "anomaly", "1", "true")


def is_unknown(rul: Column, anomaly: Column) -> Column:
    return (rul >= 60.0) & (anomaly >= 75.0)


def is_disagreement(rul: Column, anomaly: Column) -> Column:
    return ((rul >= 70.0) & (anomaly >= 65.0)) | ((rul <= 20.0) & (anomaly <= 30.0))


# Decision outcomes in test order: status and risk level (fixed values).
OUTCOMES = (
    ("UNKNOWN BEHAVIOUR", "HIGH"),
    ("MODEL DISAGREEMENT", "HIGH"),
    ("CRITICAL", "CRITICAL"),
    ("MAINTENANCE REQUIRED", "HIGH"),
    ("MONITOR", "MEDIUM"),
    ("HEALTHY", "LOW"),
)


def outcome_index(rul: Column, anomaly: Column, label: Column | None = None, limits: dict | None = None) -> Column:
    """Position in ``OUTCOMES``; the two special statuses are tested before the ordinary ones.

    NULL where a missing value leaves it open, so nothing unscored is healthy.
    """
    t = {**C.DECISION, **(limits or {})}
    flagged = F.lit(False) if label is None else is_flagged(label)
    return (
        F.when(is_unknown(rul, anomaly), 0)
        .when(is_disagreement(rul, anomaly), 1)
        .when((rul < t["critical_rul"]) | (anomaly >= t["critical_anomaly"]), 2)
        .when((rul < t["maintenance_rul"]) | (anomaly >= t["maintenance_anomaly"]), 3)
        .when((rul < t["monitor_rul"]) | (anomaly >= t["monitor_anomaly"]) | flagged, 4)
        .when(rul.isNotNull() & anomaly.isNotNull(), 5)
    )


def outcome_status(index: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s, _ in OUTCOMES]), index)


def outcome_risk(index: Column) -> Column:
    return F.get(F.array(*[F.lit(r) for _, r in OUTCOMES]), index)


def health_status(rul: Column, anomaly: Column, label: Column | None = None, limits: dict | None = None) -> Column:
    """STRUCT<status, risk> of one row."""
    index = outcome_index(rul, anomaly, label, limits)
    return F.struct(outcome_status(index).alias("status"), outcome_risk(index).alias("risk"))


def rul_component(rul: Column) -> Column:
    return clip(rul / F.lit(float(C.RUL_CAP)) * F.lit(100.0), 0.0, 100.0)


def anomaly_component(anomaly: Column) -> Column:
    return clip(F.lit(100.0) - anomaly, 0.0, 100.0)


def composite_score(rul: Column, anomaly: Column) -> Column:
    mixed = F.lit(0.6) * rul_component(rul) + F.lit(0.4) * anomaly_component(anomaly)
    return half_even(clip(mixed, 0.0, 100.0), 2)


def rul_margin(rul: Column) -> Column:
    return F.greatest(F.lit(5.0), half_even(rul * F.lit(0.12), 1))


def rul_range(rul: Column) -> tuple[Column, Column]:
    margin = rul_margin(rul)
    return F.greatest(F.lit(0.0), half_even(rul - margin, 1)), half_even(rul + margin, 1)


def confidence(rul: Column, anomaly: Column) -> Column:
    penalty = F.when(is_disagreement(rul, anomaly), F.lit(20.0)).otherwise(F.lit(0.0))
    return clip(half_even(F.lit(100.0) - anomaly * F.lit(0.35) - penalty, 1), 45.0, 98.0)


def has_sensor_text(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return (low != "") & ~low.contains("nominal") & ~low.contains("none")


def reason_template(status: Column, rul: Column, anomaly: Column) -> Column:
    """Text with the slots {rul}, {anomaly} and {sensors} still open."""
    def text(key: str) -> Column:
        return F.lit(C.REASONS[key])

    low_rul, high_anomaly = rul < 20.0, anomaly >= 80.0
    short_rul, raised_anomaly = rul < 45.0, anomaly >= 65.0
    return (
        F.when(status == "UNKNOWN BEHAVIOUR", text("unknown"))
        .when(status == "MODEL DISAGREEMENT", text("disagreement"))
        .when((status == "CRITICAL") & low_rul & high_anomaly, text("critical_both"))
        .when((status == "CRITICAL") & low_rul, text("critical_rul"))
        .when(status == "CRITICAL", text("critical_anomaly"))
        .when((status == "MAINTENANCE REQUIRED") & short_rul & raised_anomaly, text("maintenance_both"))
        .when((status == "MAINTENANCE REQUIRED") & short_rul, text("maintenance_rul"))
        .when(status == "MAINTENANCE REQUIRED", text("maintenance_anomaly"))
        .when((status == "MONITOR") & (anomaly >= 45.0), text("monitor_anomaly"))
        .when(status == "MONITOR", text("monitor_rul"))
        .when(status.isNotNull(), text("healthy"))
    )


def decision_reason(status: Column, rul: Column, anomaly: Column, sensors: Column) -> Column:
    clause = F.when(has_sensor_text(sensors), F.concat(F.lit(C.SENSOR_CLAUSE), sensors)).otherwise(F.lit(""))
    text = reason_template(status, rul, anomaly)
    for slot, value in (("{rul}", one_decimal(rul)), ("{anomaly}", one_decimal(anomaly)), ("{sensors}", clause)):
        text = F.replace(text, F.lit(slot), value)
    return text


def simple_action(rul: Column, anomaly: Column) -> Column:
    action = F.lit(C.SIMPLE_ACTION_DEFAULT)
    for max_rul, min_anomaly, text in reversed(C.SIMPLE_ACTIONS):
        action = F.when((rul <= max_rul) | (anomaly >= min_anomaly), F.lit(text)).otherwise(action)
    return action


def priority_index(composite: Column, anomaly: Column) -> Column:
    return half_even(clip(F.lit(100.0) - composite + anomaly * F.lit(0.3), 0.0, 100.0), 1)


# Weight and floor of each subsystem's health (fixed values).
SUBSYSTEM_HEALTH = (
    ("Compressor", 0.6, 10.0),
    ("Turbine", 0.45, 15.0),
    ("Thermal", 0.5, 12.0),
    ("Pressure", 0.7, 8.0),
    ("Mechanical", 0.2, 30.0),
)


def subsystem_health(anomaly: Column) -> Column:
    """MAP<subsystem, health>."""
    entries = []
    for name, weight, floor in SUBSYSTEM_HEALTH:
        entries += [F.lit(name), half_even(clip(F.lit(100.0) - anomaly * F.lit(weight), floor, 100.0), 1)]
    return F.create_map(*entries)


def weakest_subsystem(anomaly: Column) -> Column:
    """STRUCT<score, position, name> of the lowest subsystem; earlier names win ties."""
    scores = subsystem_health(anomaly)
    ranked = [
        F.struct(scores[name].alias("score"), F.lit(i).alias("position"), F.lit(name).alias("name"))
        for i, (name, _, _) in enumerate(SUBSYSTEM_HEALTH)
    ]
    return F.array_min(F.array(*ranked))


def risk_zone(rul: Column, anomaly: Column) -> Column:
    """Zone of the RUL / anomaly quadrant chart."""
    return (
        F.when((rul < 20.0) | (anomaly >= 80.0), F.lit("Critical"))
        .when(rul < 45.0, F.lit("Maintenance Required"))
        .when((rul < 75.0) & (anomaly < 65.0), F.lit("Monitoring"))
        .when((rul >= 75.0) & (anomaly < 45.0), F.lit("Nominal"))
        .otherwise(F.lit("Unshaded"))
    )
