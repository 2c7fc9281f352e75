"""Risk matrix and cost columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from bladewatch import constants as C
from bladewatch.functions.numeric import clip, half_even, pick

UNPLANNED_EVENT = (
    C.UNPLANNED_REMOVAL
    + C.GROUNDED_PER_DAY * C.GROUNDED_DAYS
    + C.SECONDARY_DAMAGE_PROBABILITY * C.SECONDARY_DAMAGE_COST
    + C.CANCELLATION_COST
)


def failure_probability(rul: Column, anomaly: Column) -> Column:
    """Chance of failure within 30 days (60 cycles)."""
    base = F.when(rul < 60.0, clip((F.lit(60.0) - rul) / F.lit(60.0), 0.0, 1.0)).otherwise(F.lit(0.02))
    return F.when(anomaly > 70.0, F.greatest(base, F.lit(0.65))).otherwise(base)


def severity_level(grounding_risk: Column, status: Column) -> Column:
    """Index 0..4 into the severity names."""
    base = F.when(grounding_risk == "high", 3).when(grounding_risk == "low", 1).otherwise(2)
    shift = F.when(status == "CRITICAL", 1).when(status == "HEALTHY", -1).otherwise(0)
    return clip(base + shift, 0, 4).cast("int")


def severity_name(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in C.SEVERITY_LEVELS]), level + 1)


def likelihood_name(probability: Column) -> Column:
    return pick(C.LIKELIHOOD_BOUNDS + ((0.0, "Improbable"),), probability)


def risk_score(severity: Column, likelihood: Column) -> Column:
    s = F.array_position(F.array(*[F.lit(x) for x in C.SEVERITY_LEVELS]), severity)
    p = F.array_position(F.array(*[F.lit(x) for x in C.LIKELIHOOD_LEVELS]), likelihood)
    return (s * p).cast("int")


def risk_band(score: Column) -> Column:
    return pick(C.RISK_BANDS, score, 1)


def risk_action(score: Column) -> Column:
    return pick(C.RISK_BANDS, score, 2)


def labour_cost(hours: Column) -> Column:
    return hours * F.lit(C.LABOUR_RATE)


def planned_cost(hours: Column) -> Column:
    return F.lit(C.PLANNED_SHOP_VISIT) + labour_cost(hours)


def deferred_cost(probability: Column) -> Column:
    return probability * F.lit(UNPLANNED_EVENT) + (F.lit(1.0) - probability) * F.lit(C.PLANNED_SHOP_VISIT)


def cost_columns(rul: Column, probability: Column, hours: Column) -> dict[str, Column]:
    deferred = deferred_cost(probability)
    planned = planned_cost(hours)
    return {
        "labour_cost": F.rint(labour_cost(hours)),
        "planned_intervention_cost": F.rint(planned),
        "unplanned_event_cost": F.rint(F.lit(UNPLANNED_EVENT)),
        "failure_probability": half_even(probability, 3),
        "expected_cost_if_deferred": F.rint(deferred),
        "expected_saving": F.rint(deferred - planned),
        "days_of_cover": half_even(rul / F.lit(C.CYCLES_PER_DAY), 1),
    }
