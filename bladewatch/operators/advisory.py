"""Cycle and fleet advisory frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bladewatch import constants as C
from bladewatch.functions import advice, health
from bladewatch.functions.accuracy import absolute_error
from bladewatch.functions.economics import cost_columns, failure_probability, likelihood_name, risk_action, risk_band
from bladewatch.functions.economics import risk_score, severity_level, severity_name
from bladewatch.functions.numeric import half_even
from bladewatch.operators.features import engine_tail


def assess(df: DataFrame, rul="predicted_RUL", anomaly="anomaly_score", label="anomaly_label",
           sensors="top_abnormal_sensors", limits: dict | None = None) -> DataFrame:
    """Adds status, composite score, risk level and decision reason as plain column expressions."""
    r, a = F.col(rul), F.col(anomaly)
    index = health.outcome_index(r, a, F.col(label) if label in df.columns else None, limits)
    decided = df.withColumn("_outcome", index).withColumns({
        "engine_health_status": health.outcome_status(F.col("_outcome")),
        "composite_health_score": health.composite_score(r, a),
        "risk_level": health.outcome_risk(F.col("_outcome")),
    })
    reason = health.decision_reason(F.col("engine_health_status"), r, a, F.col(sensors))
    return decided.withColumn("decision_reason", reason).drop("_outcome")


def recommend(df: DataFrame, status="engine_health_status", rul="predicted_RUL",
              sensors="top_abnormal_sensors") -> DataFrame:
    s = F.col(status)
    targets = advice.with_targets(df, sensors)
    names = targets.withColumn("_names", F.lower(F.concat_ws(" ", "components", "systems")))
    return names.withColumn("_tasks", advice.matched_tasks(F.col("_names"))).withColumns({
        "maintenance_recommendation": advice.recommendation(s),
        "targeted_action_items": advice.action_items(s, F.col("_tasks")),
        "impacted_components": F.array_join("components", ", "),
        "urgency_window_cycles": advice.urgency_window(s, F.col(rul)),
    }).drop("_names", "_tasks", "components", "systems")


def add_health_scores(df: DataFrame, rul="predicted_RUL", baseline: float = C.RUL_CAP) -> DataFrame:
    """Rounded score; the stage comes from the unrounded one."""
    score = health.health_score(F.col(rul), baseline)
    return df.withColumns({"health_score": half_even(score, 2), "health_status": health.health_stage(score)})


def cycle_advisory(scored: DataFrame) -> DataFrame:
    """Scored cycles with a ``predicted_RUL`` column -> full cycle-level advisory; one narrow projection chain."""
    out = scored.withColumns({
        "predicted_RUL": half_even(F.col("predicted_RUL").cast("double"), 2),
        "rul_health_score": half_even(health.health_score(F.col("predicted_RUL").cast("double")), 2),
    })
    return recommend(assess(out))


FLEET_COLUMNS = (
    "latest_observed_cycle", "predicted_RUL", "true_RUL", "absolute_error", "rul_health_score",
    "latest_anomaly_score", "latest_anomaly_status", "latest_anomaly_severity", "top_abnormal_sensors",
    "engine_health_status", "composite_health_score", "risk_level", "maintenance_recommendation",
    "decision_reason", "targeted_action_items", "impacted_components", "urgency_window_cycles",
)


def fleet_advisory(scored: DataFrame) -> DataFrame:
    """Latest advisory row per engine.

    The last cycle is taken first, with a map-side combined aggregate, and the decision texts are
    computed only for the rows that remain.
    """
    needed = [c for c in (*C.UNIT, "cycle", "predicted_RUL", "true_RUL", "anomaly_score", "anomaly_label",
                          "anomaly_severity", "top_abnormal_sensors", "deviations") if c in scored.columns]
    last = cycle_advisory(engine_tail(scored.select(*needed)))
    renamed = last.withColumnsRenamed({
        "cycle": "latest_observed_cycle", "anomaly_score": "latest_anomaly_score",
        "anomaly_label": "latest_anomaly_status", "anomaly_severity": "latest_anomaly_severity"})
    columns = list(FLEET_COLUMNS)
    if "true_RUL" in renamed.columns:
        error = absolute_error(F.col("true_RUL"), F.col("predicted_RUL"))
        renamed = renamed.withColumn("absolute_error", error)
    else:
        columns = [c for c in columns if c not in ("true_RUL", "absolute_error")]
    extra = [F.get("deviations", F.lit(0))["sensor"].alias("leading_sensor")] if "deviations" in renamed.columns else []
    return renamed.select(*C.UNIT, *columns, *extra, F.lit(C.DISCLAIMER).alias("disclaimer"))


def status_is(name: str) -> Column:
    return F.col("engine_health_status") == name


def executive_report(fleet: DataFrame, cycles: DataFrame) -> DataFrame:
    """One row per subset: status counts and shares, risk counts and means.

    Statuses outside the four stages are counted as ``other``. Engine lists come from ``flagged_engines``.
    """
    n = F.count(F.lit(1))
    slug = {"HEALTHY": "healthy", "MONITOR": "monitor", "MAINTENANCE REQUIRED": "maintenance", "CRITICAL": "critical"}
    counts = [F.count_if(status_is(s)).alias(f"{slug[s]}_count") for s in C.STATUSES]
    shares = [half_even(F.count_if(status_is(s)) / n * 100.0, 1).alias(f"{slug[s]}_pct") for s in C.STATUSES]
    risks = [F.count_if(F.col("risk_level") == r).alias(f"risk_{r.lower()}") for r in ("LOW", "MEDIUM", "HIGH",
                                                                                      "CRITICAL")]
    totals = cycles.groupBy("subset").agg(F.count(F.lit(1)).alias("total_cycles_evaluated"))
    report = fleet.groupBy("subset").agg(
        n.alias("total_fleet_engines"), *counts, *shares,
        F.count_if(~F.col("engine_health_status").isin(*C.STATUSES)).alias("other_count"), *risks,
        half_even(F.avg("predicted_RUL"), 2).alias("mean_predicted_rul"),
        half_even(F.avg("latest_anomaly_score"), 2).alias("mean_anomaly_score"),
        half_even(F.avg("composite_health_score"), 2).alias("mean_composite_health"))
    return report.join(totals, "subset")


def flagged_engines(fleet: DataFrame) -> DataFrame:
    """Critical and maintenance-required engines as rows (subset, list, engine_id)."""
    return fleet.filter(F.col("engine_health_status").isin("CRITICAL", "MAINTENANCE REQUIRED")).select(
        "subset", F.col("engine_health_status").alias("list"), "engine_id")


def fleet_summary(fleet: DataFrame) -> DataFrame:
    return fleet.groupBy("subset").agg(
        F.count(F.lit(1)).alias("total_engines"),
        F.count_if(status_is("HEALTHY")).alias("healthy"), F.count_if(status_is("MONITOR")).alias("monitor"),
        F.count_if(status_is("MAINTENANCE REQUIRED")).alias("maintenance_required"),
        F.count_if(status_is("CRITICAL")).alias("critical"),
        F.count_if(~F.col("engine_health_status").isin(*C.STATUSES)).alias("other"),
        half_even(F.avg("predicted_RUL"), 2).alias("mean_predicted_rul"),
        half_even(F.avg("latest_anomaly_score"), 2).alias("mean_anomaly_score"),
        half_even(F.avg("composite_health_score"), 2).alias("mean_composite_health"))


def primary_fault(fleet: DataFrame) -> Column:
    """The leading sensor when known, else the default text."""
    default = F.lit(C.DEFAULT_FAULT)
    return F.coalesce(F.col("leading_sensor"), default) if "leading_sensor" in fleet.columns else default


def priority_ranking(fleet: DataFrame) -> DataFrame:
    """Engines with codes and priority index, most urgent first."""
    ranked = fleet.select(
        *C.UNIT, advice.engine_code(F.col("engine_id")).alias("engine_code"),
        advice.aircraft_code(F.col("engine_id")).alias("aircraft_code"), "latest_observed_cycle", "predicted_RUL",
        "latest_anomaly_score", "engine_health_status", "composite_health_score", "risk_level",
        health.priority_index(F.col("composite_health_score"), F.col("latest_anomaly_score")).alias("priority_score"),
        primary_fault(fleet).alias("primary_fault"))
    return ranked.orderBy(F.col("priority_score").desc(), "engine_id")


def merge_rul_and_anomaly(predictions: DataFrame, summary: DataFrame) -> DataFrame:
    """Last-cycle RUL predictions left-joined with the engine anomaly summary, plus the simple action."""
    anomaly = summary.select(*C.UNIT, "final_anomaly_score", "final_anomaly_severity", "final_anomaly_status",
                             "anomaly_cycle_ratio_pct", "top_degraded_sensors")
    score = F.coalesce(F.col("final_anomaly_score"), F.lit(0.0))
    return predictions.join(anomaly, list(C.UNIT), "left").withColumn(
        "recommended_action", health.simple_action(F.col("predicted_RUL"), score))


def protocol_dim(spark) -> DataFrame:
    schema = "subsystem string, protocol_code string, protocol_title string, labour_hours double, " \
             "aog_risk string, window_days int"
    return spark.createDataFrame([tuple(r) for r in C.PROTOCOLS], schema)


def sensor_dim(spark) -> DataFrame:
    rows = [(s, int(s.split("_")[1]), n, c, y) for s, n, c, y in C.SENSOR_DIM]
    return spark.createDataFrame(rows, "sensor string, position int, name string, component string, system string")


PROTOCOL_FIELDS = ("protocol_code", "protocol_title", "labour_hours", "aog_risk", "window_days")


def with_protocol(df: DataFrame, subsystem: str = "subsystem") -> DataFrame:
    """Protocol columns by subsystem; an unlisted subsystem gets the ``Unclassified`` protocol."""
    default = next(r for r in C.PROTOCOLS if r[0] == "Unclassified")
    dim = protocol_dim(df.sparkSession).withColumnRenamed("subsystem", subsystem)
    out = df.join(F.broadcast(dim), subsystem, "left")
    return out.withColumns({
        name: F.coalesce(F.col(name), F.lit(value)) for name, value in zip(PROTOCOL_FIELDS, default[1:])})


def economics(fleet: DataFrame, exact_token: bool = False) -> DataFrame:
    """Per-engine failure probability, risk rating and costs."""
    rul, anomaly = F.col("predicted_RUL"), F.col("latest_anomaly_score")
    faults = fleet.withColumn("primary_fault", primary_fault(fleet))
    base = with_protocol(faults.withColumns({
        "subsystem": advice.subsystem_of(F.col("primary_fault"), exact_token),
        "probability": failure_probability(rul, anomaly)}))
    rated = base.withColumns({
        "severity": severity_name(severity_level(F.col("aog_risk"), F.col("engine_health_status"))),
        "likelihood": likelihood_name(F.col("probability"))})
    rated = rated.withColumn("risk_score", risk_score(F.col("severity"), F.col("likelihood")))
    rated = rated.withColumns({"risk_band": risk_band(F.col("risk_score")),
                               "risk_action": risk_action(F.col("risk_score"))})
    return rated.withColumns(cost_columns(rul, F.col("probability"), F.col("labour_hours")))


def cost_summary(costs: DataFrame) -> DataFrame:
    saving = F.col("expected_saving")
    worth = F.count_if(saving > 0)
    total = F.sum(F.when(saving > 0, saving).otherwise(0.0))
    bands = [F.count_if(F.col("risk_band") == b).alias(f"band_{b.lower()}") for _, b, _ in C.RISK_BANDS]
    return costs.groupBy("subset").agg(
        F.count(F.lit(1)).alias("total_engines"), F.rint(total).alias("total_expected_savings"),
        worth.alias("engines_worth_intervening"),
        F.rint(total / F.greatest(worth, F.lit(1))).alias("mean_saving_per_intervention"),
        F.rint(F.sum("expected_cost_if_deferred")).alias("total_deferred_exposure"), *bands)


def assess_request(df: DataFrame) -> DataFrame:
    """Scores rows of (predicted_RUL, anomaly_score, anomaly_label, top_abnormal_sensors) sent by a caller."""
    r, a = F.col("predicted_RUL"), F.col("anomaly_score")
    low, high = health.rul_range(r)
    return recommend(assess(df)).withColumns({
        "confidence_pct": health.confidence(r, a), "expected_rul_low": low, "expected_rul_high": high,
        "is_unknown_behaviour": health.is_unknown(r, a), "is_model_disagreement": health.is_disagreement(r, a)})


def compare_scenarios(df: DataFrame) -> DataFrame:
    """What-if rows: current_rul / current_anomaly against simulated_rul / simulated_anomaly."""
    def part(prefix: str, rul: Column, anomaly: Column) -> dict[str, Column]:
        decision = health.health_status(rul, anomaly)
        return {f"{prefix}_status": decision["status"], f"{prefix}_risk": decision["risk"],
                f"{prefix}_composite": health.composite_score(rul, anomaly)}

    sim_rul, sim_anomaly, text = F.col("simulated_rul"), F.col("simulated_anomaly"), F.col("simulated_sensors")
    both = df.withColumns({
        **part("before", F.col("current_rul"), F.col("current_anomaly")), **part("after", sim_rul, sim_anomaly)})
    advised = recommend(both, "after_status", "simulated_rul", "simulated_sensors").drop("impacted_components")
    return advised.withColumns({
        "after_confidence": health.confidence(sim_rul, sim_anomaly),
        "after_reason": health.decision_reason(F.col("after_status"), sim_rul, sim_anomaly, text),
    }).withColumnsRenamed({
        "maintenance_recommendation": "after_recommendation", "targeted_action_items": "after_actions",
        "urgency_window_cycles": "after_urgency"})
