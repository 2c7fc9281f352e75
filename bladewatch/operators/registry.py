"""Registry tables: engines, work orders, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bladewatch.constants import UNIT
from bladewatch.functions.advice import aircraft_code, engine_code
from bladewatch.functions.numeric import half_even, one_decimal
from bladewatch.operators.advisory import primary_fault

# Fixed values of the registry rows.
ENGINE_MODEL = "Turbofan CFM56-7B"
INSTALLED, INSPECTED, NEXT_DUE = "2022-04-15", "2026-06-10", "2026-09-01"
HOURS_PER_CYCLE = 2.8
FIRST_AIRCRAFT = "AR-042"


def engine_registry(fleet: DataFrame) -> DataFrame:
    """Registry row per engine of the fleet advisory."""
    engine = F.col("engine_id")
    odd = F.pmod(engine, F.lit(2)) != 0
    return fleet.select(
        engine_code(engine).alias("engine_code"), "engine_id", "subset",
        F.when(engine == 1, F.lit(FIRST_AIRCRAFT)).otherwise(aircraft_code(engine)).alias("aircraft_code"),
        F.concat(F.lit("SN-CFM56-"), (engine + 8000).cast("string")).alias("serial_number"),
        F.lit(ENGINE_MODEL).alias("engine_model"),
        F.when(odd, F.lit("LEFT")).otherwise(F.lit("RIGHT")).alias("position"),
        F.lit(INSTALLED).alias("installation_date"), F.col("latest_observed_cycle").alias("total_cycles"),
        half_even(F.col("latest_observed_cycle") * F.lit(HOURS_PER_CYCLE), 1).alias("total_hours"),
        F.col("predicted_RUL").alias("current_rul"), F.col("composite_health_score").alias("health_index"),
        F.col("engine_health_status").alias("status"), "risk_level", F.lit(INSPECTED).alias("last_inspection"),
        F.lit(NEXT_DUE).alias("next_maintenance"), primary_fault(fleet).alias("primary_fault"))


def aircraft_with_engines(aircraft: DataFrame, engines: DataFrame, key: str) -> DataFrame:
    """Aircraft left-joined with their engines as flat rows, plus the engine count of each aircraft.

    Rows stay flat because a few aircraft codes may carry most engines; a nested list would put them in one row.
    """
    counts = engines.groupBy(key).agg(F.count(F.lit(1)).alias("engine_count"))
    return aircraft.join(counts, key, "left").fillna({"engine_count": 0}).join(engines, key, "left")


def current_work_orders(log: DataFrame) -> DataFrame:
    """Current state per work order from its append-only log (work_order_id, at, seq, status, ...)."""
    rest = [c for c in log.columns if c != "work_order_id"]
    latest = F.max_by(F.struct(*rest), F.struct("at", "seq"))
    opened = F.min(F.struct("at", "seq"))
    return log.groupBy("work_order_id").agg(
        latest.alias("now"), opened["at"].alias("created_at"), F.count(F.lit(1)).alias("changes"),
    ).select("work_order_id", "created_at", "changes", "now.*")


def newest_first(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*[F.col(k).desc() for k in keys])


def work_order_requests(fleet: DataFrame) -> DataFrame:
    """Opening rows for engines whose advice calls for work."""
    priority = F.when(F.col("engine_health_status") == "CRITICAL", "HIGH").otherwise("MEDIUM")
    return fleet.filter(F.col("urgency_window_cycles") >= 0).select(
        engine_code(F.col("engine_id")).alias("engine_code"), aircraft_code(F.col("engine_id")).alias("aircraft_code"),
        F.col("maintenance_recommendation").alias("issue_summary"), priority.alias("priority"),
        F.col("targeted_action_items").alias("recommended_action"), "urgency_window_cycles",
        F.lit("OPEN").alias("status"))


def alerts(fleet: DataFrame) -> DataFrame:
    """Alert rows derived from the advisory: raised anomaly scores and low remaining life."""
    rul, anomaly = F.col("predicted_RUL"), F.col("latest_anomaly_score")

    def row(kind: str, severity, message):
        return F.struct(F.lit(kind).alias("alert_type"), severity.alias("severity"), message.alias("message"))

    raised = F.when(anomaly >= 65.0, row(
        "ANOMALY", F.when(anomaly >= 80.0, F.lit("CRITICAL")).otherwise(F.lit("WARNING")),
        F.concat(F.lit("Elevated sensor deviation (score "), one_decimal(anomaly), F.lit("/100)"))))
    short = F.when(rul < 20.0, row(
        "LOW_RUL", F.lit("CRITICAL"),
        F.concat(F.lit("End of life predicted (RUL "), one_decimal(rul), F.lit(" cycles)"))))
    return fleet.select(
        *UNIT, engine_code(F.col("engine_id")).alias("engine_code"),
        aircraft_code(F.col("engine_id")).alias("aircraft_code"), "latest_observed_cycle",
        rul.alias("predicted_rul"), anomaly.alias("anomaly_score"), F.lit("UNACKNOWLEDGED").alias("status"),
        F.inline(F.array_compact(F.array(raised, short))))
