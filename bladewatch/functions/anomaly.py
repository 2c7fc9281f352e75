"""Anomaly score and sensor-deviation columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from bladewatch import constants as C
from bladewatch.functions.numeric import clip, fixed, half_even, pick


def deviation_severity(z: Column) -> Column:
    return pick(C.DEVIATION_LEVELS, F.abs(z), 1)


def deviation_contribution(z: Column) -> Column:
    return pick(C.DEVIATION_LEVELS, F.abs(z), 2)


def deviation_level(z: Column) -> Column:
    """Position in the deviation levels, 0 the most severe."""
    size = F.abs(z)
    level = F.lit(len(C.DEVIATION_LEVELS) - 1)
    for i in range(len(C.DEVIATION_LEVELS) - 2, -1, -1):
        level = F.when(size >= C.DEVIATION_LEVELS[i][0], i).otherwise(level)
    return level


def level_text(level: Column, position: int) -> Column:
    return F.get(F.array(*[F.lit(row[position]) for row in C.DEVIATION_LEVELS]), level)


def anomaly_severity(score: Column) -> Column:
    return pick(C.ANOMALY_SEVERITIES, score)


def calibrated_score(raw: Column, low: Column, high: Column) -> Column:
    """0 (nominal) .. 100 (severe) from a raw decision score and its calibration bounds."""
    return half_even(clip((high - raw) / (high - low) * F.lit(100.0), 0.0, 100.0), 2)


def anomaly_label(score: Column, vote: Column | None = None, threshold: float = C.ANOMALY_THRESHOLD) -> Column:
    hit = score >= threshold
    if vote is not None:
        hit = hit | (vote == -1)
    return F.when(hit, F.lit("Anomalous")).otherwise(F.lit("Normal"))


def sigma_text(sensor: Column, z: Column, severity: Column) -> Column:
    """``sensor_3 (+2.10σ, High deviation)``."""
    sign = F.when(z >= 0.0, F.lit("+")).otherwise(F.lit(""))
    return F.concat(sensor, F.lit(" ("), sign, fixed(z, 2), F.lit("σ, "), severity, F.lit(")"))
