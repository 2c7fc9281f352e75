"""Queries over the data stages: cleaning, labels, statistics, features, normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from bladewatch import constants as C
from bladewatch.catalog import sql_base as S
from bladewatch.catalog.inputs import test_rows, train_rows
from bladewatch.catalog.sql_base import FRAME, SENSORS, SETTINGS, UNIT, rnd, with_ctes
from bladewatch.functions.numeric import half_even
from bladewatch.operators import features, labels, quality, regimes, stats
from bladewatch.sources.supplied import dirty_telemetry, ground_truth, hot_units, labelled, settings_telemetry, telemetry

QUERIES, SQL = {}, {}


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


MEASURED = ("engine_id", "cycle") + SETTINGS + SENSORS


# --- cleaning -----------------------------------------------------------------------------------
@register("p1_inf_to_missing", with_ctes(
    f"SELECT {FRAME}, CAST(sum({' + '.join(f'CAST(coalesce(isinf({s}), false) AS INTEGER)' for s in SENSORS)}) "
    f"AS BIGINT) AS infinite_values_found FROM dirty GROUP BY ALL", "dirty"))
def p1_inf_to_missing(spark, sf_dir):
    return quality.inf_counts(dirty_telemetry(spark, sf_dir))


@register("p2_missing_counts", with_ctes(" UNION ALL ".join(
    f"SELECT {FRAME}, count(*) AS rows, '{c}' AS column_name, count(*) - count({c}) AS missing FROM mended GROUP BY ALL"
    for c in MEASURED), "mended"))
def p2_missing_counts(spark, sf_dir):
    return quality.missing_counts(dirty_telemetry(spark, sf_dir))


@register("p3_drop_all_missing", with_ctes(
    f"SELECT {FRAME}, count(*) AS rows_kept FROM mended WHERE coalesce({', '.join(MEASURED)}) IS NOT NULL GROUP BY ALL",
    "mended"))
def p3_drop_all_missing(spark, sf_dir):
    kept = quality.drop_all_missing(quality.inf_to_missing(dirty_telemetry(spark, sf_dir)))
    return kept.groupBy(*C.FRAME).agg(F.count(F.lit(1)).alias("rows_kept"))


@register("p4_duplicates", with_ctes(
    f"SELECT {FRAME}, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM ("
    f"SELECT {FRAME}, {', '.join(MEASURED)}, count(*) AS n FROM mended "
    f"WHERE coalesce({', '.join(MEASURED)}) IS NOT NULL GROUP BY ALL) GROUP BY ALL", "mended"))
def p4_duplicates(spark, sf_dir):
    return quality.duplicate_counts(quality.drop_all_missing(quality.inf_to_missing(dirty_telemetry(spark, sf_dir))))


@register("p4_deduplicated_rows", with_ctes(
    f"SELECT DISTINCT * FROM mended WHERE coalesce({', '.join(MEASURED)}) IS NOT NULL", "mended"))
def p4_deduplicated_rows(spark, sf_dir):
    return quality.clean(dirty_telemetry(spark, sf_dir))


@register("p5_invalid_keys", with_ctes(
    f"SELECT {FRAME}, count(*) FILTER (WHERE cycle <= 0) AS invalid_cycle_values, "
    f"count(*) FILTER (WHERE engine_id <= 0) AS invalid_engine_id_values FROM (SELECT DISTINCT * FROM mended) "
    f"GROUP BY ALL", "mended"))
def p5_invalid_keys(spark, sf_dir):
    return quality.invalid_keys(quality.clean(dirty_telemetry(spark, sf_dir)))


def _listed(low, high):
    items = ", ".join(f"CASE WHEN var_samp({s}) > {low} AND var_samp({s}) <= {high} THEN '{s}' END" for s in SENSORS)
    return f"array_to_string(list_filter([{items}], lambda a: a IS NOT NULL), ',')"


_nulls = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in MEASURED)


@register("p6_quality_report", with_ctes(f"""
SELECT * FROM (
  SELECT {FRAME}, count(*) AS original_rows, CAST(sum({_nulls}) AS BIGINT) AS total_missing_values,
    count(*) FILTER (WHERE {_nulls} = {len(MEASURED)}) AS fully_missing_rows_dropped FROM mended GROUP BY ALL)
JOIN (SELECT {FRAME}, CAST(sum({' + '.join(f'CAST(coalesce(isinf({s}), false) AS INTEGER)' for s in SENSORS)})
    AS BIGINT) AS infinite_values_found FROM dirty GROUP BY ALL) USING ({FRAME})
JOIN (SELECT {FRAME}, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows_removed FROM (
    SELECT {FRAME}, {', '.join(MEASURED)}, count(*) AS n FROM mended WHERE {_nulls} < {len(MEASURED)}
    GROUP BY ALL) GROUP BY ALL) USING ({FRAME})
JOIN (SELECT {FRAME}, count(*) AS cleaned_rows, count(*) FILTER (WHERE cycle <= 0) AS invalid_cycle_values,
    count(*) FILTER (WHERE engine_id <= 0) AS invalid_engine_id_values,
    {_listed(-1, 1e-10)} AS constant_sensors, {_listed(1e-10, 1e-3)} AS near_constant_sensors,
    {rnd('var_samp(sensor_2)', 4)} AS variance_sensor_2,
    {rnd('coalesce(stddev_samp(sensor_3) / abs(nullif(avg(sensor_3), 0)), 0)', 6)} AS cv_sensor_3
  FROM (SELECT DISTINCT * FROM mended WHERE {_nulls} < {len(MEASURED)}) GROUP BY ALL) USING ({FRAME})""",
    "dirty", "mended"))
def p6_quality_report(spark, sf_dir):
    report = quality.quality_report(dirty_telemetry(spark, sf_dir))
    return report.withColumns({
        "variance_sensor_2": half_even(F.col("sensor_variances")["sensor_2"], 4),
        "cv_sensor_3": half_even(F.col("sensor_coefficient_of_variation")["sensor_3"], 6),
    }).drop("sensor_variances", "sensor_coefficient_of_variation", "columns")


@register("p6_sensor_variation", with_ctes(" UNION ALL ".join(
    f"SELECT {FRAME}, '{s}' AS sensor, {rnd(f'var_samp({s})', 1)} AS variance, "
    f"{rnd(f'coalesce(stddev_samp({s}) / abs(nullif(avg({s}), 0)), 0)', 6)} AS cv FROM (SELECT DISTINCT * FROM mended "
    f"WHERE {_nulls} < {len(MEASURED)}) GROUP BY ALL" for s in SENSORS), "mended"))
def p6_sensor_variation(spark, sf_dir):
    """Every sensor's variance and variation coefficient of the report, in long form."""
    report = quality.quality_report(dirty_telemetry(spark, sf_dir))
    long = report.select(*C.FRAME, F.explode("sensor_variances").alias("sensor", "variance"),
                         F.col("sensor_coefficient_of_variation").alias("cvs"))
    return long.select(*C.FRAME, "sensor", half_even(F.col("variance"), 1).alias("variance"),
                       half_even(F.element_at("cvs", F.col("sensor")), 6).alias("cv"))


@register("p7_feature_selection", with_ctes(" UNION ALL ".join(
    f"SELECT {FRAME}, '{c}' AS feature, {rnd(f'var_samp({c})', 1)} AS variance, var_samp({c}) > 1e-10 AS selected "
    f"FROM lab GROUP BY ALL" for c in SETTINGS + SENSORS), "lab"))
def p7_feature_selection(spark, sf_dir):
    return quality.rounded(quality.selected_features(labelled(spark, sf_dir)), 1)


@register("p8_feature_target", with_ctes(
    f"SELECT {UNIT}, cycle, {', '.join(SETTINGS + SENSORS)}, RUL_capped AS target FROM lab", "lab"))
def p8_feature_target(spark, sf_dir):
    return quality.model_frame(labelled(spark, sf_dir))


@register("p14_output_checks", with_ctes(f"""
WITH c AS (SELECT {FRAME}, CAST(sum({' + '.join(f'CAST({c} IS NULL AS INTEGER)' for c in MEASURED)}) AS BIGINT) AS a,
  CAST(sum({' + '.join(f'CAST(isinf({s}) AS INTEGER)' for s in SENSORS)}) AS BIGINT) AS b,
  count(*) FILTER (WHERE RUL < 0) AS n FROM lab GROUP BY ALL)
SELECT {FRAME}, v.*, violations = 0 AS passed FROM c, LATERAL (VALUES ('no_missing', a), ('no_infinite', b),
  ('rul_not_negative', n), ('ids_present', 0), ('same_columns', 0)) v("check", violations)""", "lab"))
def p14_output_checks(spark, sf_dir):
    lab = labelled(spark, sf_dir)
    return quality.output_checks(lab, test_rows(lab).columns)


_KEPT = [c for c in MEASURED if c not in ("sensor_9", "RUL", "RUL_capped")]


def _checked(source, split, columns, sensors, negative):
    return f"""SELECT {FRAME}, CAST(sum({' + '.join(f'CAST({c} IS NULL AS INTEGER)' for c in columns)}) AS BIGINT) AS a,
  CAST(sum({' + '.join(f'CAST(coalesce(isinf({s}), false) AS INTEGER)' for s in sensors)}) AS BIGINT) AS b, {negative} AS n
  FROM {source} WHERE split = '{split}' GROUP BY ALL"""


@register("p14_frame_checks", with_ctes(f"""
WITH c AS ({_checked('lab', 'train', MEASURED, SENSORS, 'count(*) FILTER (WHERE RUL < 0)')} UNION ALL
  {_checked('dirty', 'test', _KEPT, [s for s in SENSORS if s != 'sensor_9'], 'CAST(0 AS BIGINT)')})
SELECT {FRAME}, v.*, violations = 0 AS passed FROM c, LATERAL (VALUES ('no_missing', a), ('no_infinite', b),
  ('rul_not_negative', n), ('ids_present', 0), ('same_columns', 3)) v("check", violations)""", "lab", "dirty"))
def p14_frame_checks(spark, sf_dir):
    """Training rows against a test frame that was never cleaned, has no labels and lacks a sensor."""
    test = test_rows(dirty_telemetry(spark, sf_dir)).drop("sensor_9")
    return quality.frame_checks(train_rows(labelled(spark, sf_dir)), test)


@register("p15_nonnegative_labels", with_ctes(f"SELECT {FRAME}, count(*) AS rows FROM lab WHERE RUL >= 0 GROUP BY ALL",
                                              "lab"))
def p15_nonnegative_labels(spark, sf_dir):
    checked = quality.assert_labels(labelled(spark, sf_dir, sensors=()))
    return checked.groupBy(*C.FRAME).agg(F.count(F.lit(1)).alias("rows"))


# --- labels -------------------------------------------------------------------------------------
@register("e1_train_rul", with_ctes(
    f"SELECT {UNIT}, cycle, RUL, RUL_capped FROM lab WHERE split = 'train'", "lab"))
def e1_train_rul(spark, sf_dir):
    train = train_rows(telemetry(spark, sf_dir, sensors=()))
    out = labels.add_train_rul(train, split_hot=hot_units(spark, sf_dir))
    return out.select(*C.UNIT, "cycle", "RUL", "RUL_capped")


@register("e2_test_rul", with_ctes(
    f"SELECT {UNIT}, cycle, RUL, RUL_capped FROM lab WHERE split = 'test'", "lab"))
def e2_test_rul(spark, sf_dir):
    test = test_rows(telemetry(spark, sf_dir, sensors=()))
    truth = ground_truth(spark, sf_dir)
    labels.check_truth_counts(test, truth)
    out = labels.add_test_rul(test, truth, split_hot=hot_units(spark, sf_dir))
    return out.select(*C.UNIT, "cycle", "RUL", "RUL_capped")


@register("j2_true_rul_by_engine", with_ctes(
    f"SELECT {UNIT}, engine_ordinal, true_rul FROM known WHERE split = 'test'", "known"))
def j2_true_rul_by_engine(spark, sf_dir):
    return labels.true_rul_by_engine(test_rows(telemetry(spark, sf_dir, sensors=())), ground_truth(spark, sf_dir))


# --- statistics ---------------------------------------------------------------------------------
@register("a1_sensor_variance", with_ctes(" UNION ALL ".join(
    f"SELECT {FRAME}, '{s}' AS sensor, {rnd(f'var_samp({s})', 1)} AS variance, CASE WHEN var_samp({s}) <= 1e-10 THEN "
    f"'constant' WHEN var_samp({s}) <= 1e-3 THEN 'near_constant' ELSE 'variable' END AS category FROM tel GROUP BY ALL"
    for s in SENSORS), "tel"))
def a1_sensor_variance(spark, sf_dir):
    return quality.rounded(stats.sensor_variances(telemetry(spark, sf_dir)), 1)


@register("a2_variation_coefficient", with_ctes(" UNION ALL ".join(
    f"SELECT {FRAME}, '{s}' AS sensor, {rnd(f'coalesce(stddev_samp({s}) / abs(nullif(avg({s}), 0)), 0)', 6)} AS cv "
    f"FROM tel GROUP BY ALL" for s in SENSORS), "tel"))
def a2_variation_coefficient(spark, sf_dir):
    return quality.rounded(stats.variation_coefficients(telemetry(spark, sf_dir)), 6)


def _sensor_stats_sql(s):
    corr = f"CASE WHEN stddev_samp({s}) > 0 THEN covar_samp({s}, cycle) / (stddev_samp({s}) * stddev_samp(cycle)) END"
    return f"""SELECT {FRAME}, '{s}' AS sensor, {rnd(f'avg({s})', 4)} AS mean, {rnd(f'stddev_samp({s})', 4)} AS std,
      {rnd(f'min({s})', 4)} AS min, {rnd(f'max({s})', 4)} AS max, {rnd(f'var_samp({s})', 1)} AS variance,
      count(DISTINCT {s}) AS unique_values, {rnd(corr, 4)} AS corr_with_cycle,
      {rnd(f'100e0 * (count(*) - count({s})) / count(*)', 4)} AS missing_pct,
      CASE WHEN var_samp({s}) <= 1e-10 THEN 'constant' WHEN var_samp({s}) <= 1e-3 THEN 'near_constant'
        ELSE 'variable' END AS category,
      coalesce(var_samp({s}) > 1e-3 AND abs({corr}) >= 0.1, false) AS is_potentially_useful
    FROM tel GROUP BY ALL"""


SENSOR_STATS_SQL = " UNION ALL ".join(_sensor_stats_sql(s) for s in SENSORS)


@register("a3_sensor_statistics", with_ctes(SENSOR_STATS_SQL, "tel"))
def a3_sensor_statistics(spark, sf_dir):
    out = stats.sensor_statistics(telemetry(spark, sf_dir))
    return quality.rounded(out.withColumn("variance", half_even(F.col("variance"), 1)), 4)


@register("a4_engine_lifetimes", with_ctes(
    f"SELECT {FRAME}, count(*) AS engines, {rnd('avg(last_cycle)', 4)} AS mean_lifetime, min(last_cycle) AS "
    f"min_lifetime, max(last_cycle) AS max_lifetime, {rnd('stddev_samp(last_cycle)', 4)} AS std_lifetime, "
    f"{rnd('quantile_cont(CAST(last_cycle AS DOUBLE), 0.5)', 4)} AS median_lifetime FROM ends GROUP BY ALL", "ends"))
def a4_engine_lifetimes(spark, sf_dir):
    return quality.rounded(stats.lifetime_statistics(telemetry(spark, sf_dir, sensors=())), 4)


@register("a5_dataset_report", with_ctes(f"""
WITH st AS ({SENSOR_STATS_SQL}), rows AS (
  SELECT subset, count(*) FILTER (WHERE split = 'train') AS train_rows,
    count(*) FILTER (WHERE split = 'test') AS test_rows, max(cycle) FILTER (WHERE split = 'train') AS total_cycles,
    CAST(0 AS BIGINT) AS train_missing, CAST(0 AS BIGINT) AS test_missing, CAST(0 AS BIGINT) AS train_duplicates,
    {rnd("avg(RUL) FILTER (WHERE split = 'train')", 2)} AS mean_RUL,
    {rnd("stddev_samp(RUL) FILTER (WHERE split = 'train')", 2)} AS std_RUL,
    min(RUL) FILTER (WHERE split = 'train') AS min_RUL, max(RUL) FILTER (WHERE split = 'train') AS max_RUL,
    {rnd("avg(RUL_capped) FILTER (WHERE split = 'train')", 2)} AS mean_RUL_capped FROM lab GROUP BY ALL),
eng AS (
  SELECT subset, count(*) FILTER (WHERE split = 'train') AS train_engines,
    count(*) FILTER (WHERE split = 'test') AS test_engines,
    {rnd("avg(last_cycle) FILTER (WHERE split = 'train')", 2)} AS engine_lifetime_avg_cycles,
    min(last_cycle) FILTER (WHERE split = 'train') AS engine_lifetime_min_cycles,
    max(last_cycle) FILTER (WHERE split = 'train') AS engine_lifetime_max_cycles FROM ends GROUP BY ALL),
lists AS (
  SELECT subset, {', '.join(f"coalesce(string_agg(sensor, ',' ORDER BY CAST(substr(sensor, 8) AS INTEGER)) FILTER (WHERE {cond}), '') AS {name}" for name, cond in (("constant_sensors", "category = 'constant'"), ("near_constant_sensors", "category = 'near_constant'"), ("useful_sensors", "is_potentially_useful")))}
  FROM st WHERE split = 'train' GROUP BY ALL)
SELECT *, {len(SENSORS)} AS n_sensors, 3 AS n_settings FROM rows JOIN eng USING (subset) JOIN lists USING (subset)""",
    "tel", "lab", "ends"))
def a5_dataset_report(spark, sf_dir):
    return quality.rounded(stats.dataset_report(labelled(spark, sf_dir)), 2)


@register("a6_run_summary", with_ctes("""
SELECT coalesce(subset, 'TOTAL') AS subset, CAST(sum(CASE WHEN split = 'train' THEN last_cycle ELSE 0 END) AS BIGINT)
  AS train_rows, CAST(sum(CASE WHEN split = 'test' THEN last_cycle ELSE 0 END) AS BIGINT) AS test_rows,
  count(*) FILTER (WHERE split = 'train') AS engines FROM ends GROUP BY ROLLUP (subset)""", "ends"))
def a6_run_summary(spark, sf_dir):
    return stats.run_summary(labelled(spark, sf_dir, sensors=()))


@register("a7_healthy_baseline", with_ctes(
    "SELECT subset, sensor, " + ", ".join(f"{rnd(c, 4)} AS {c}" for c in ("mean", "std", "min", "max", "p25", "p75"))
    + " FROM baseline", "baseline"))
def a7_healthy_baseline(spark, sf_dir):
    return quality.rounded(stats.baseline_statistics(train_rows(labelled(spark, sf_dir))), 4)


def _regime_sql(table):
    return " UNION ALL ".join(
        f"SELECT subset, _regime, '{s}' AS sensor, {rnd(f'avg({s})', 4)} AS mean, "
        f"{rnd(f'CASE WHEN stddev_samp({s}) >= 1e-6 THEN stddev_samp({s}) ELSE 1 END', 4)} AS std FROM {table} "
        f"WHERE subset IN (SELECT subset FROM {table} GROUP BY subset HAVING var_samp({s}) > 1e-5) GROUP BY ALL"
        for s in SENSORS)


_ASSIGNED = ("WITH reg AS (SELECT *, CAST(CASE WHEN subset IN ('FD002', 'FD004') THEN setting_3 - 1 ELSE 0 END AS "
             "INTEGER) AS _regime FROM {src})")


def given_regime(df):
    """Regime taken from setting_3 in the two multi-regime subsets."""
    many = F.col("subset").isin("FD002", "FD004")
    return df.withColumn("_regime", F.when(many, F.col("setting_3") - 1).otherwise(0).cast("int"))


def _stats_long(wide):
    sensors = [c[5:] for c in wide.columns if c.startswith("mean_")]
    entries = [F.struct(F.lit(s).alias("sensor"), F.col(f"mean_{s}").alias("mean"), F.col(f"std_{s}").alias("std"))
               for s in sensors]
    return wide.select("subset", "_regime", F.inline(F.array(*entries))).filter("mean is not null")


@register("a9_regime_statistics", with_ctes(
    _ASSIGNED.format(src="lab WHERE split = 'train'") + _regime_sql("reg"), "lab"))
def a9_regime_statistics(spark, sf_dir):
    train = given_regime(train_rows(labelled(spark, sf_dir)))
    return quality.rounded(_stats_long(regimes.regime_statistics(train)), 4)


def _norm_sql():
    parts = ", ".join(
        f"var_{s} > 1e-5 AS use_{s}" for s in SENSORS)
    out = ", ".join(
        rnd(f"CASE WHEN use_{s} THEN (r.{s} - coalesce(m_{s}, 0)) / coalesce(s_{s}, 1) ELSE r.{s} END", 4) + f" AS {s}"
        for s in SENSORS)
    return _ASSIGNED.format(src="lab") + f""", st AS (SELECT subset, _regime, {', '.join(
        f'avg({s}) AS m_{s}, CASE WHEN stddev_samp({s}) >= 1e-6 THEN stddev_samp({s}) ELSE 1 END AS s_{s}'
        for s in SENSORS)} FROM reg WHERE split = 'train' GROUP BY ALL),
    va AS (SELECT subset, {parts} FROM (SELECT subset, {', '.join(f'var_samp({s}) AS var_{s}' for s in SENSORS)}
      FROM reg WHERE split = 'train' GROUP BY ALL))
    SELECT r.subset, r.split, r.engine_id, r.cycle, r._regime, {out} FROM reg r LEFT JOIN va USING (subset)
    LEFT JOIN st ON r.subset = st.subset AND r._regime = st._regime"""


@register("m2_regime_normalised", with_ctes(_norm_sql(), "lab"))
def m2_regime_normalised(spark, sf_dir):
    lab = given_regime(labelled(spark, sf_dir))
    out = regimes.normalise(lab, regimes.regime_statistics(train_rows(lab)))
    return quality.rounded(out.select(*C.UNIT, "cycle", "_regime", *SENSORS), 4)


def _scale_sql(shift, span):
    cols = SETTINGS + SENSORS
    return f"""WITH b AS (SELECT subset, {', '.join(f'{shift.format(c=c)} AS a_{c}, {span.format(c=c)} AS b_{c}'
      for c in cols)} FROM lab WHERE split = 'train' GROUP BY ALL)
    SELECT {UNIT}, cycle, {', '.join(rnd(f'({c} - a_{c}) / CASE WHEN b_{c} > 0 THEN b_{c} ELSE 1 END', 4) + f' AS {c}'
      for c in cols)} FROM lab LEFT JOIN b USING (subset)"""


@register("m3_minmax_scaled", with_ctes(_scale_sql("min({c})", "max({c}) - min({c})"), "lab"))
def m3_minmax_scaled(spark, sf_dir):
    lab = labelled(spark, sf_dir)
    out = regimes.scale(lab, train_rows(lab), "minmax").drop("RUL", "RUL_capped")
    return quality.rounded(out, 4)


@register("m3_standard_scaled", with_ctes(_scale_sql("avg({c})", "stddev_pop({c})"), "lab"))
def m3_standard_scaled(spark, sf_dir):
    lab = labelled(spark, sf_dir)
    out = regimes.scale(lab, train_rows(lab), "standard").drop("RUL", "RUL_capped")
    return quality.rounded(out, 4)


# --- windows ------------------------------------------------------------------------------------
_W = f"(PARTITION BY {UNIT} ORDER BY cycle)"
_R = f"(PARTITION BY {UNIT} ORDER BY cycle ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"


def _feature_sql(kind, s):
    diff = f"coalesce({s} - lag({s}) OVER {_W}, 0e0)"
    return {
        "rolling_mean": f"avg({s}) OVER {_R}",
        "rolling_std": f"coalesce(stddev_samp({s}) OVER {_R}, 0e0)",
        "diff": diff,
        "pct_change": f"CASE WHEN abs(lag({s}) OVER {_W}) > 1e-9 THEN {diff} / abs(lag({s}) OVER {_W}) * 100e0 "
                      f"ELSE 0e0 END",
    }[kind]


def _window_query(kind, digits=3):
    def run(spark, sf_dir):
        tel = telemetry(spark, sf_dir)
        out = features.engineer_features(tel, settings=[], split_hot=hot_units(spark, sf_dir))
        return quality.rounded(out.select(*C.UNIT, "cycle", *[f"{s}_{kind}" for s in SENSORS]), digits)

    sql = with_ctes(f"SELECT {UNIT}, cycle, " + ", ".join(
        f"{rnd(_feature_sql(kind, s), digits)} AS {s}_{kind}" for s in SENSORS) + " FROM tel", "tel")
    return run, sql


for _key, _kind in (("w1_rolling_mean", "rolling_mean"), ("w2_rolling_std", "rolling_std"),
                    ("w3_lag_difference", "diff"), ("w4_percent_change", "pct_change")):
    QUERIES[_key], SQL[_key] = _window_query(_kind)


@register("w5_settings_rolling_mean", with_ctes(f"SELECT {UNIT}, cycle, " + ", ".join(
    f"{rnd(f'avg({s}) OVER {_R}', 4)} AS {s}_rolling_mean" for s in SETTINGS) + " FROM tel", "tel"))
def w5_settings_rolling_mean(spark, sf_dir):
    tel = settings_telemetry(spark, sf_dir)
    out = features.engineer_features(tel, split_hot=hot_units(spark, sf_dir))
    return quality.rounded(out.select(*C.UNIT, "cycle", *[f"{s}_rolling_mean" for s in SETTINGS]), 4)


@register("w6_last_cycle_row", with_ctes(
    f"SELECT * FROM tel QUALIFY row_number() OVER (PARTITION BY {UNIT} ORDER BY cycle DESC) = 1", "tel"))
def w6_last_cycle_row(spark, sf_dir):
    return features.engine_tail(telemetry(spark, sf_dir))


@register("w7_first_cycles", with_ctes("SELECT * FROM tel WHERE cycle <= 30", "tel"))
def w7_first_cycles(spark, sf_dir):
    return features.first_cycles(telemetry(spark, sf_dir), C.EARLY_CYCLES)


def rolled(spark, sf_dir):
    """Labelled frame with all features, used by the model queries."""
    return features.engineer_features(labelled(spark, sf_dir), split_hot=hot_units(spark, sf_dir))


__all__ = ["QUERIES", "SQL", "S", "rolled"]
