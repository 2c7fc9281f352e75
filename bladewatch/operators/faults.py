"""Fault overlay on telemetry and detection latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bladewatch import constants as C
from bladewatch.functions.numeric import half_even
from bladewatch.operators.features import present
from bladewatch.operators.ordering import first_mark_from, running_sums

BLOCK_CYCLES = 1 << 18  # block length for engines too large for one task


def fault_steps(injections: DataFrame) -> DataFrame:
    """Injections (UNIT, fault, magnitude, injected_at_cycle) as slope and level changes of the fault effect.

    A ramp rises by magnitude/ramp per cycle from its start and is level after ``ramp`` cycles; a step is level
    at once. Two rows per injection describe that, so effects are running sums instead of injection x cycle pairs.
    """
    dim = injections.sparkSession.createDataFrame(
        [(f, o, float(max(1, r))) for f, _, o, r, _ in C.FAULTS], "fault string, onset string, ramp double")
    known = injections.join(F.broadcast(dim), "fault")
    m, start, ramp = F.col("magnitude"), F.col("injected_at_cycle").cast("double"), F.col("ramp")
    step = F.col("onset") == "step"
    zero = F.lit(0.0)
    begin = F.struct(
        F.col("injected_at_cycle").cast("long").alias("cycle"),
        F.when(step, zero).otherwise(m / ramp).alias("slope"),
        F.when(step, m).otherwise(-m * start / ramp).alias("level"))
    finish = F.struct(
        (F.col("injected_at_cycle") + ramp.cast("long")).cast("long").alias("cycle"),
        F.when(step, zero).otherwise(-m / ramp).alias("slope"),
        F.when(step, zero).otherwise(m + m * start / ramp).alias("level"))
    changes = known.select(*C.UNIT, "fault", F.inline(F.array(begin, finish)))
    per_fault = []
    for fault, *_ in C.FAULTS:
        hit = F.col("fault") == fault
        per_fault += [F.sum(F.when(hit, F.col("slope")).otherwise(0.0)).alias(f"slope_{fault}"),
                      F.sum(F.when(hit, F.col("level")).otherwise(0.0)).alias(f"level_{fault}")]
    return changes.groupBy(*C.UNIT, "cycle").agg(*per_fault)


def fault_effects(df: DataFrame, injections: DataFrame, block: int | None = None) -> tuple[DataFrame, dict]:
    """Telemetry with the running effect of each fault, and the effect expression per sensor."""
    columns = [f"{kind}_{fault}" for fault, *_ in C.FAULTS for kind in ("slope", "level")]
    rows = df.withColumns({c: F.lit(0.0) for c in columns}).withColumn("_row", F.lit(True))
    steps = fault_steps(injections).withColumn("_row", F.lit(False))
    both = rows.unionByName(steps, allowMissingColumns=True)
    summed = running_sums(both, list(C.UNIT), "cycle", columns, block).filter("_row").drop("_row")
    active = summed.withColumns({
        f"effect_{fault}": half_even(F.col(f"slope_{fault}") * F.col("cycle") + F.col(f"level_{fault}"), 12)
        for fault, *_ in C.FAULTS}).drop(*columns)
    effects: dict[str, Column] = {}
    for fault, _, _, _, weights in C.FAULTS:
        for sensor, weight in weights.items():
            term = F.col(f"effect_{fault}") * F.lit(weight)
            effects[sensor] = effects[sensor] + term if sensor in effects else term
    return active, effects


def overlay_faults(df: DataFrame, injections: DataFrame, baseline: DataFrame, block: int | None = None) -> DataFrame:
    """Sensors shifted by effect x baseline std, total effect, and the raised anomaly score.

    ``df`` brings ``anomaly_score``; the total counts every affected sensor, measured or not.
    """
    active, effects = fault_effects(df, injections, block)
    total = F.lit(0.0)
    for effect in effects.values():
        total = total + F.abs(effect)
    scales = [f"std_{s}" for s in present(df, C.SENSORS) if f"std_{s}" in baseline.columns]
    joined = active.join(F.broadcast(baseline.select("subset", *scales)), "subset", "left")
    shifted = {
        s: F.col(s) + F.coalesce(effects[s] * F.col(f"std_{s}"), F.lit(0.0))
        for s in present(df, C.SENSORS) if s in effects and f"std_{s}" in scales}
    # Sums carry residue in the last bits; it is dropped before anything is rounded to few digits.
    out = joined.withColumn("fault_magnitude", half_even(total, 9)).withColumns(shifted)
    raised = F.least(F.lit(100.0), F.col("anomaly_score") + F.col("fault_magnitude") * 12.0)
    return out.withColumn("faulted_score", half_even(half_even(raised, 6), 1)).drop(
        *scales, *[f"effect_{f}" for f, *_ in C.FAULTS])


def detection_latency(injections: DataFrame, scored: DataFrame, score: str = "faulted_score",
                      threshold: float = C.ANOMALY_THRESHOLD, block: int | None = None) -> DataFrame:
    """First cycle at or after each injection whose score reaches the threshold, and the cycles it took."""
    marks = scored.filter(F.col(score) >= threshold).select(*C.UNIT, "cycle").distinct()
    points = injections.withColumn("cycle", F.col("injected_at_cycle").cast("long"))
    found = first_mark_from(points, marks, list(C.UNIT), "cycle", "detected_at_cycle", block)
    return found.withColumn("latency_cycles", F.col("detected_at_cycle") - F.col("injected_at_cycle")).drop("cycle")
