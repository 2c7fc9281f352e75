"""Sensor-level explanation of anomalous cycles and the summaries built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bladewatch import constants as C
from bladewatch.functions.anomaly import (
    anomaly_label, anomaly_severity, deviation_level, level_text, sigma_text,
)
from bladewatch.functions.numeric import half_even
from bladewatch.operators.features import present


def baseline_z(df: DataFrame, baseline: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Joins the wide baseline (one row per subset) and returns z-score expressions per sensor.

    A subset without a baseline keeps its rows, with NULL z-scores.
    """
    sensors = [s for s in present(df, C.SENSORS) if f"mean_{s}" in baseline.columns]
    joined = df.join(F.broadcast(baseline), "subset", "left")
    return joined, {s: F.expr(f"({s} - mean_{s}) / std_{s}") for s in sensors}


def add_deviations(df: DataFrame, baseline: DataFrame, top: int = 3) -> DataFrame:
    """Adds ``deviations``, ``ranked_sensors``, ``top_abnormal_sensors``, ``max_sensor_deviation``, ``largest_z``.

    ``deviations`` is ARRAY<STRUCT<sensor, z, abs_dev, severity, contribution>>, largest |z| first; equal |z|
    keep sensor order and unused sensors take no part. The ranking is one sort of a small array inside the row and
    the ranks are unrolled, so the whole step stays in generated code and needs no shuffle.
    """
    joined, z = baseline_z(df, baseline)
    names = list(z)
    top = min(top, len(names))
    scored = joined.select(*df.columns, *[F.expr(f"({s} - mean_{s}) / std_{s} AS _q{i}") for i, s in enumerate(names)])
    # Unused sensors have NULL moments; key 1.0 puts them behind every real -|z|.
    entries = ", ".join(f"struct(coalesce(-abs(_q{i}), 1D) AS key, {i} AS pos, _q{i} AS exact)"
                        for i in range(len(names)))
    ranked = scored.select(*df.columns, F.expr(f"sort_array(array({entries}))").alias("_ranked"))
    listed = ", ".join(f"'{s}'" for s in names)
    cells = {"largest_z": F.expr("CASE WHEN _ranked[0].key <= 0 THEN -_ranked[0].key END")}
    for k in range(top):
        cells[f"_z{k}"] = F.expr(f"rint(get(_ranked, {k}).exact * 100D) / 100D")
        cells[f"_s{k}"] = F.expr(f"CASE WHEN get(_ranked, {k}).key <= 0 THEN get(array({listed}), "
                                 f"get(_ranked, {k}).pos) END")
    out = ranked.withColumns(cells)
    out = out.withColumns({f"_l{k}": deviation_level(F.col(f"_z{k}")) for k in range(top)})
    out = out.withColumns({f"_v{k}": level_text(F.col(f"_l{k}"), 1) for k in range(top)})
    structs = [
        F.struct(F.col(f"_s{k}").alias("sensor"), F.col(f"_z{k}").alias("z"), F.abs(f"_z{k}").alias("abs_dev"),
                 F.col(f"_v{k}").alias("severity"), level_text(F.col(f"_l{k}"), 2).alias("contribution"))
        for k in range(top)]
    used = F.expr(" + ".join(f"CAST(_s{k} IS NOT NULL AS INT)" for k in range(top)))
    texts = [F.when(F.abs(f"_z{k}") >= 1.0, sigma_text(F.col(f"_s{k}"), F.col(f"_z{k}"), F.col(f"_v{k}")))
             for k in range(top)]
    summary = F.when(F.abs("_z0") >= 1.0, F.concat_ws(" | ", *texts)).otherwise(F.lit(C.NOMINAL_TEXT))
    return out.select(
        *df.columns, F.slice(F.array(*structs), 1, used).alias("deviations"),
        F.slice(F.array(*[F.col(f"_s{k}") for k in range(top)]), 1, used).alias("ranked_sensors"), summary.alias("top_abnormal_sensors"), F.abs("_z0").alias("max_sensor_deviation"), "largest_z")


def explain(df: DataFrame, baseline: DataFrame, top: int = 3) -> DataFrame:
    """Adds ``deviations`` (ranked array), ``top_abnormal_sensors`` and ``max_sensor_deviation``."""
    return add_deviations(df, baseline, top).drop("largest_z")


def flatten_ranks(df: DataFrame, top: int = 3) -> DataFrame:
    """``deviations`` as flat ``top_sensor_k*`` columns."""
    out = {}
    for k in range(1, top + 1):
        entry = F.get("deviations", F.lit(k - 1))
        out[f"top_sensor_{k}"] = entry["sensor"]
        out[f"top_sensor_{k}_zscore"] = entry["z"]
        out[f"top_sensor_{k}_abs_dev"] = entry["abs_dev"]
        out[f"top_sensor_{k}_severity"] = entry["severity"]
        out[f"top_sensor_{k}_contribution"] = entry["contribution"]
    return df.withColumns(out).drop("deviations", "ranked_sensors")


def rule_scores(df: DataFrame, baseline: DataFrame, top: int = 3) -> DataFrame:
    """Rule-based stand-in for a model: score = 25 x the largest |z|, capped at 100."""
    ranked = add_deviations(df, baseline, top)
    known = F.col("largest_z").isNotNull()
    score = F.when(known, half_even(F.least(F.lit(100.0), F.lit(25.0) * F.col("largest_z")), 2))
    scored = ranked.withColumn("anomaly_score", score)
    return scored.withColumns({
        "anomaly_label": F.when(known, anomaly_label(F.col("anomaly_score"))),
        "anomaly_severity": F.when(known, anomaly_severity(F.col("anomaly_score"))),
    }).drop("largest_z")


def sensor_position(name: Column) -> Column:
    return F.regexp_extract(name, r"(\d+)", 1).cast("int")


def engine_summary(scored: DataFrame) -> DataFrame:
    """One row per engine: last state, anomaly counts, first anomalous cycle, two leading sensors."""
    hit = F.col("anomaly_label") == "Anomalous"
    # First per (engine, leading sensor, texts), whose values have a fixed size, so that no row is sorted; then per leading
    # sensor, then per engine: one pass, and at most one row per sensor reaches an array.
    texts = ("anomaly_severity", "anomaly_label")
    cells = scored.groupBy(*C.UNIT, F.get("ranked_sensors", F.lit(0)).alias("sensor"), *texts).agg(
        F.max("cycle").alias("cycle"), F.max_by("anomaly_score", "cycle").alias("anomaly_score"),
        F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"), F.min(F.when(hit, F.col("cycle"))).alias("first"))
    parts = cells.groupBy(*C.UNIT, "sensor").agg(
        F.max_by(F.struct("cycle", "anomaly_score", *texts), "cycle").alias("last"),
        F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.min("first").alias("first"))
    leader = F.struct((-F.col("hits")).alias("k"), sensor_position(F.col("sensor")).alias("p"), "sensor")
    base = parts.groupBy(*C.UNIT).agg(
        F.max_by("last", F.col("last.cycle")).alias("last"),
        F.sum("n").alias("total_cycles_observed"), F.sum("hits").alias("total_anomalous_cycles"),
        F.coalesce(F.min("first"), F.lit(-1)).alias("first_anomalous_cycle"),
        F.sort_array(F.collect_list(F.when(F.col("hits") > 0, leader))).alias("ranked"))
    names = F.transform(F.slice("ranked", 1, 2), lambda e: e["sensor"])
    ratio = F.col("total_anomalous_cycles") / F.col("total_cycles_observed") * 100.0
    return base.select(
        *C.UNIT, F.col("last.cycle").alias("last_observed_cycle"),
        F.col("last.anomaly_score").alias("final_anomaly_score"),
        F.col("last.anomaly_severity").alias("final_anomaly_severity"),
        F.col("last.anomaly_label").alias("final_anomaly_status"),
        "total_cycles_observed", "total_anomalous_cycles", half_even(ratio, 2).alias("anomaly_cycle_ratio_pct"),
        "first_anomalous_cycle",
        F.when(F.size("ranked") > 0, F.array_join(names, ", ")).otherwise(F.lit("None (Nominal)"))
        .alias("top_degraded_sensors"),
    )


def fleet_sensor_ranking(scored: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """How often each sensor leads or is in the top three, over anomalous rows (all rows if none)."""
    hit = F.col("anomaly_label") == "Anomalous"
    # Rows are counted per ranked triple first; only those few combinations are taken apart.
    triples = scored.groupBy("subset", hit.alias("hit"), F.col("ranked_sensors").alias("names")).agg(
        F.count(F.lit(1)).alias("n"))
    ranked = triples.select("subset", "hit", "n", F.posexplode("names").alias("at", "sensor"))

    def total(keep: Column) -> Column:
        return F.sum(F.when(keep, F.col("n")).otherwise(0))

    counts = ranked.groupBy("subset", "sensor").agg(
        total(F.col("hit") & (F.col("at") == 0)).alias("hit_1"), total(F.col("hit")).alias("hit_3"),
        total(F.col("at") == 0).alias("all_1"), F.sum("n").alias("all_3"))
    # Every row has one leading sensor, so the leading counts add up to the rows.
    totals = counts.groupBy("subset").agg(F.sum("hit_1").alias("hits"), F.sum("all_1").alias("rows"))
    sensors = used if used is not None else counts.select("subset", "sensor")
    joined = sensors.join(counts, ["subset", "sensor"], "left").join(F.broadcast(totals), "subset")
    any_hit = F.col("hits") > 0
    first = F.coalesce(F.when(any_hit, F.col("hit_1")).otherwise(F.col("all_1")), F.lit(0))
    third = F.coalesce(F.when(any_hit, F.col("hit_3")).otherwise(F.col("all_3")), F.lit(0))
    of = F.when(any_hit, F.col("hits")).otherwise(F.col("rows"))
    return joined.select(
        "subset", "sensor", first.alias("top_1_abnormal_count"), third.alias("top_3_abnormal_count"),
        half_even(first / of * 100.0, 2).alias("top_1_frequency_pct"))


def top_sensors(ranking: DataFrame, k: int = 5) -> DataFrame:
    """First k rows of the ranking per subset; a subset has at most one row per sensor."""
    order = Window.partitionBy("subset").orderBy(F.col("top_1_abnormal_count").desc(), sensor_position(F.col("sensor")))
    return ranking.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def report_document(report: DataFrame, ranking: DataFrame, k: int = 5) -> DataFrame:
    """The anomaly report with ``top_contributing_sensors``, at most ``k`` per subset, most frequent first."""
    entry = F.struct("sensor", "top_1_frequency_pct", "top_1_abnormal_count")
    top = top_sensors(ranking, k).groupBy("subset").agg(F.sort_array(F.collect_list(F.struct("rank", entry.alias("e")))).alias("t"))
    listed = top.select("subset", F.transform("t", lambda x: x["e"]).alias("top_contributing_sensors"))
    return report.join(listed, "subset", "left")


def anomaly_report(scored: DataFrame, summary: DataFrame) -> DataFrame:
    """One row per subset with totals, shares, mean scores and the severity histogram."""
    hit = F.col("anomaly_label") == "Anomalous"
    severities = [s for _, s in C.ANOMALY_SEVERITIES]
    cycles = scored.groupBy("subset").agg(
        F.count(F.lit(1)).alias("total_test_cycles"), F.count_if(hit).alias("anomalous_cycles_count"),
        F.avg("anomaly_score").alias("mean_anomaly_score_fleet"),
        *[F.count_if(F.col("anomaly_severity") == s).alias(s) for s in severities])
    engines = summary.groupBy("subset").agg(
        F.count(F.lit(1)).alias("total_test_engines"),
        F.count_if(F.col("total_anomalous_cycles") > 0).alias("engines_exhibiting_anomalies_count"),
        F.avg("final_anomaly_score").alias("mean_anomaly_score_last_cycle"))
    histogram = F.map_from_arrays(F.array(*[F.lit(s) for s in severities]), F.array(*[F.col(s) for s in severities]))
    return cycles.join(engines, "subset").select(
        "subset", "total_test_engines", "total_test_cycles", "anomalous_cycles_count",
        half_even(F.col("anomalous_cycles_count") / F.col("total_test_cycles") * 100.0, 2)
        .alias("anomalous_cycles_pct"),
        "engines_exhibiting_anomalies_count",
        half_even(F.col("engines_exhibiting_anomalies_count") / F.col("total_test_engines") * 100.0, 2)
        .alias("engines_exhibiting_anomalies_pct"),
        half_even(F.col("mean_anomaly_score_fleet"), 2).alias("mean_anomaly_score_fleet"),
        half_even(F.col("mean_anomaly_score_last_cycle"), 2).alias("mean_anomaly_score_last_cycle"),
        histogram.alias("severity_distribution"))
