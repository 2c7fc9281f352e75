"""Queries for the chart tables, fault overlay, intervals and fleet risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from bladewatch import constants as C
from bladewatch.catalog import sql_base as S
from bladewatch.catalog.data_queries import SENSOR_STATS_SQL
from bladewatch.catalog.inputs import fleet, life_predictions, scored, test_rows, train_rows
from bladewatch.catalog.sql_base import SENSORS, SETTINGS, UNIT, rnd, with_ctes
from bladewatch.functions.numeric import clip, half_even
from bladewatch.operators import faults, plotdata, risk, uncertainty
from bladewatch.operators.quality import rounded
from bladewatch.operators.stats import baseline_moments, lifetimes
from bladewatch.sources.stages import materialise
from bladewatch.sources.supplied import hot_units, labelled, table, telemetry, unit_columns

QUERIES, SQL = {}, {}


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


KEY = (*C.UNIT, "cycle")
K = f"{UNIT}, cycle"
TRAIN = "(SELECT * FROM lab WHERE split = 'train')"


def _train(spark, sf_dir):
    return train_rows(labelled(spark, sf_dir))


def _staged_train(spark, sf_dir):
    """Training rows written once, for queries that pass over them several times."""
    return materialise(_train(spark, sf_dir), "train")


# --- chart tables -------------------------------------------------------------------------------
@register("v1_box_summary", with_ctes(" UNION ALL ".join(
    f"SELECT subset, '{s}' AS sensor, " + ", ".join(
        f"{rnd(f'quantile_cont({s}, {p})', 4)} AS {n}" for p, n in
        ((0.0, "low"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1.0, "high")))
    + f" FROM {TRAIN} GROUP BY ALL HAVING var_samp({s}) > 1e-10" for s in SENSORS), "lab"))
def v1_box_summary(spark, sf_dir):
    return rounded(plotdata.box_summary(_staged_train(spark, sf_dir)), 4)


_COLS = ("cycle",) + SENSORS


def _corr(a, b):
    return f"CASE WHEN stddev_samp({a}) > 0 AND stddev_samp({b}) > 0 THEN covar_samp({a}, {b}) / " \
           f"(stddev_samp({a}) * stddev_samp({b})) END"


@register("v2_correlation_matrix", with_ctes(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT subset, '{a}' AS row, '{b}' AS col, {rnd(_corr(a, b), 4)} AS corr FROM {TRAIN} GROUP BY ALL"
        for i, a in enumerate(_COLS) for b in _COLS[:i]) + ") WHERE corr IS NOT NULL", "lab"))
def v2_correlation_matrix(spark, sf_dir):
    return rounded(plotdata.correlation_matrix(_train(spark, sf_dir)), 4)


@register("v3_variance_ranking", with_ctes(
    " UNION ALL ".join(
        f"SELECT subset, '{s}' AS sensor, {rnd(f'var_samp({s})', 1)} AS variance, var_samp({s}) <= 1e-3 AS "
        f"near_constant FROM {TRAIN} GROUP BY ALL HAVING var_samp({s}) > 0" for s in SENSORS), "lab"))
def v3_variance_ranking(spark, sf_dir):
    return rounded(plotdata.variance_ranking(_train(spark, sf_dir)), 1)


def _first_ids(n, source=TRAIN):
    return f"(SELECT subset, engine_id FROM (SELECT DISTINCT subset, engine_id FROM {source}) " \
           f"QUALIFY row_number() OVER (PARTITION BY subset ORDER BY engine_id) <= {n})"


@register("v4_mean_trend", with_ctes(
    f"SELECT subset, cycle, {', '.join(f'{rnd(f'CAST(sum(CAST({s} AS DECIMAL(28,9))) AS DOUBLE) / count({s})', 4)} AS {s}' for s in SENSORS)} FROM {TRAIN} "
    f"JOIN {_first_ids(10)} USING (subset, engine_id) GROUP BY ALL", "lab"))
def v4_mean_trend(spark, sf_dir):
    return rounded(plotdata.mean_trend(_train(spark, sf_dir)), 4)


_CASES = " ".join(f"WHEN '{s}' THEN {s}" for s in SENSORS)


@register("v5_degradation_curves", with_ctes(f"""
WITH st AS ({SENSOR_STATS_SQL}), best AS (SELECT subset, sensor FROM st WHERE split = 'train' AND category <> 'constant'
  QUALIFY row_number() OVER (PARTITION BY subset ORDER BY coalesce(abs(corr_with_cycle), -1) DESC,
    CAST(substr(sensor, 8) AS INTEGER)) = 1)
SELECT subset, engine_id, cycle, sensor, {rnd(f'CASE sensor {_CASES} END', 4)} AS value FROM {TRAIN}
JOIN {_first_ids(20)} USING (subset, engine_id) JOIN best USING (subset)""", "lab", "tel"))
def v5_degradation_curves(spark, sf_dir):
    return rounded(plotdata.degradation_curves(_train(spark, sf_dir)), 4)


def histogram_sql(source, column, bins):
    return f"""SELECT subset, bin, {rnd('lo + bin * w', 4)} AS bin_left, {rnd('lo + bin * w + w', 4)} AS bin_right,
      count(*) AS frequency, {rnd('count(*) / (any_value(n) * any_value(w))', 6)} AS density FROM (
      SELECT subset, lo, w, n, CAST(least(floor((x - lo) / w), {bins - 1}) AS INTEGER) AS bin FROM (
        SELECT subset, CAST({column} AS DOUBLE) AS x FROM {source}) JOIN (
        SELECT subset, CASE WHEN lo = hi THEN lo - 0.5e0 ELSE lo END AS lo, n,
          (CASE WHEN lo = hi THEN hi + 0.5e0 ELSE hi END - CASE WHEN lo = hi THEN lo - 0.5e0 ELSE lo END)
            / {bins}e0 AS w
        FROM (SELECT subset, CAST(min({column}) AS DOUBLE) AS lo, CAST(max({column}) AS DOUBLE) AS hi, count(*) AS n
          FROM {source} GROUP BY ALL)) USING (subset)) GROUP BY subset, bin, lo, w"""


def _hist(df):
    return df.withColumns({"bin_left": half_even(F.col("bin_left"), 4), "bin_right": half_even(F.col("bin_right"), 4),
                           "density": half_even(F.col("density"), 6)})


@register("v6_rul_histogram", with_ctes(histogram_sql(TRAIN, "RUL", 50), "lab"))
def v6_rul_histogram(spark, sf_dir):
    return _hist(plotdata.histogram(train_rows(labelled(spark, sf_dir, sensors=())), "RUL", 50))


@register("v6_capped_rul_histogram", with_ctes(histogram_sql(TRAIN, "RUL_capped", 50), "lab"))
def v6_capped_rul_histogram(spark, sf_dir):
    return _hist(plotdata.histogram(train_rows(labelled(spark, sf_dir, sensors=())), "RUL_capped", 50))


@register("v6_lifetime_histogram", with_ctes(
    histogram_sql("(SELECT * FROM ends WHERE split = 'train')", "last_cycle", 30), "ends"))
def v6_lifetime_histogram(spark, sf_dir):
    return _hist(plotdata.histogram(lifetimes(train_rows(telemetry(spark, sf_dir, sensors=()))), "lifetime", 30))


@register("v6_score_histogram", with_ctes(
    f"WITH h AS ({histogram_sql('(SELECT * FROM scored WHERE split = ' + S.q('test') + ')', 'anomaly_score', 50)}) "
    f"SELECT *, {S.steps(C.ANOMALY_SEVERITIES, '(bin_left + bin_right) / 2e0')} AS stage FROM h", "scored"))
def v6_score_histogram(spark, sf_dir):
    return _hist(plotdata.score_histogram(test_rows(scored(spark, sf_dir))))


@register("v7_operating_points", with_ctes(" UNION ALL ".join(
    f"SELECT subset, engine_id, cycle, '{a}' AS x_name, '{b}' AS y_name, {a} AS x, {b} AS y FROM tel"
    for i, a in enumerate(SETTINGS) for b in SETTINGS[i + 1:]), "tel"))
def v7_operating_points(spark, sf_dir):
    return plotdata.operating_points(telemetry(spark, sf_dir, sensors=()))


@register("v8_normalised_statistics", with_ctes(
    "WITH st AS (" + " UNION ALL ".join(
        f"SELECT subset, '{s}' AS sensor, avg({s}) AS mean, stddev_samp({s}) AS std, min({s}) AS min, max({s}) AS max "
        f"FROM {TRAIN} GROUP BY ALL HAVING var_samp({s}) > 1e-10" for s in SENSORS) + ") SELECT subset, sensor, "
    + ", ".join(rnd(f'({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w + 1e-12)', 4) + f" AS {c}"
                for c in ("mean", "std", "min", "max")) + " FROM st WINDOW w AS (PARTITION BY subset)", "lab"))
def v8_normalised_statistics(spark, sf_dir):
    return rounded(plotdata.normalised_statistics(_train(spark, sf_dir)), 4)


@register("v9_lifetime_comparison", with_ctes(
    f"SELECT subset, count(*) AS engines, {rnd('avg(last_cycle)', 4)} AS mean, {rnd('stddev_samp(last_cycle)', 4)} AS "
    f"std, min(last_cycle) AS min, max(last_cycle) AS max FROM ends WHERE split = 'train' GROUP BY ALL", "ends"))
def v9_lifetime_comparison(spark, sf_dir):
    return rounded(plotdata.lifetime_comparison(train_rows(telemetry(spark, sf_dir, sensors=()))), 4)


@register("v10_correlation_by_subset", with_ctes(
    f"WITH st AS ({SENSOR_STATS_SQL}) SELECT sensor, " + ", ".join(
        f"coalesce(max(corr_with_cycle) FILTER (WHERE subset = '{s}'), 0e0) AS {s}" for s in C.SUBSETS)
    + " FROM st WHERE split = 'train' AND category <> 'constant' GROUP BY ALL", "tel"))
def v10_correlation_by_subset(spark, sf_dir):
    return rounded(plotdata.correlation_by_subset(_train(spark, sf_dir)), 4)


@register("v11_status_distribution", with_ctes(
    "SELECT f.subset, s.status, s.position, count(*) FILTER (WHERE shown = s.status) AS engines, "
    + rnd("count(*) FILTER (WHERE shown = s.status) / CAST(count(*) AS DOUBLE) * 100e0", 1)
    + f" AS pct FROM (SELECT subset, CASE WHEN engine_health_status IN ({', '.join(repr(s) for s in C.STATUSES)}) THEN "
    f"engine_health_status ELSE 'OTHER' END AS shown FROM fleet) f, "
    f"(VALUES {S.values([(s, i) for i, s in enumerate([*C.STATUSES, 'OTHER'])])}) s(status, position) "
    f"GROUP BY ALL", "fleet"))
def v11_status_distribution(spark, sf_dir):
    return plotdata.status_distribution(fleet(spark, sf_dir))


@register("v12_risk_quadrant", with_ctes(
    f"SELECT {UNIT}, predicted_RUL, latest_anomaly_score, engine_health_status, CASE WHEN predicted_RUL < 20 OR "
    f"latest_anomaly_score >= 80 THEN 'Critical' WHEN predicted_RUL < 45 THEN 'Maintenance Required' WHEN "
    f"predicted_RUL < 75 AND latest_anomaly_score < 65 THEN 'Monitoring' WHEN predicted_RUL >= 75 AND "
    f"latest_anomaly_score < 45 THEN 'Nominal' ELSE 'Unshaded' END AS zone FROM fleet", "fleet"))
def v12_risk_quadrant(spark, sf_dir):
    return plotdata.risk_quadrant(fleet(spark, sf_dir))


@register("v13_sample_timelines", with_ctes(f"""
WITH named AS (SELECT DISTINCT subset, engine_id FROM scored WHERE engine_id IN (1, 5, 10, 20)),
ids AS (SELECT * FROM named UNION ALL SELECT f.* FROM {_first_ids(4, 'scored')} f
  WHERE f.subset NOT IN (SELECT subset FROM named))
SELECT subset, engine_id, cycle, anomaly_score, anomaly_label, predicted_RUL, true_RUL
FROM scored JOIN ids USING (subset, engine_id)""", "scored"))
def v13_sample_timelines(spark, sf_dir):
    return plotdata.sample_timelines(
        scored(spark, sf_dir), ["anomaly_score", "anomaly_label", "predicted_RUL", "true_RUL"])


@register("v14_anomalous_spans", with_ctes(
    f"SELECT {UNIT}, min(cycle) AS first_cycle, max(cycle) AS last_cycle, count(*) AS cycles FROM (SELECT *, cycle - "
    f"row_number() OVER (PARTITION BY {UNIT} ORDER BY cycle) AS island FROM scored WHERE anomaly_label = 'Anomalous') "
    f"GROUP BY {UNIT}, island", "scored"))
def v14_anomalous_spans(spark, sf_dir):
    return plotdata.anomalous_spans(scored(spark, sf_dir), _block(spark, sf_dir))


# --- faults -------------------------------------------------------------------------------------
# Injections from the error events: the unit, the time of life, the size and the fault come from the event.
_FAULT_NAMES = [f for f, *_ in C.FAULTS]
_INJ = f"""inj AS (SELECT event_id AS injection_id, {S._UNITS.format(k='user_id')},
    [{', '.join(S.q(f) for f in _FAULT_NAMES)}][1 + k % 5] AS fault, 0.1e0 + k / 100e0 AS magnitude,
    CAST(k * 5 + 1 AS BIGINT) AS injected_at_cycle
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'error'))"""
_ONSET = "CASE fault " + " ".join(
    f"WHEN '{f}' THEN " + ("1e0" if o == "step" else f"least(1e0, (cycle - injected_at_cycle) / {float(r)}e0)")
    for f, _, o, r, _ in C.FAULTS) + " END"
_AFFECTED = sorted({s for *_, w in C.FAULTS for s in w}, key=lambda s: int(s.split("_")[1]))


def _weights(sensor):
    return "CASE fault " + " ".join(f"WHEN '{f}' THEN {w[sensor]!r}e0" for f, _, _, _, w in C.FAULTS if sensor in w) \
        + " ELSE 0e0 END"


_SHIFTED = [s for s in SENSORS if s in _AFFECTED]
_OVERLAY = f"""{_INJ}, eff AS (SELECT {K}, {', '.join(f'sum({_weights(s)} * f) AS e_{s}' for s in _AFFECTED)} FROM (
    SELECT s.subset, s.split, s.engine_id, s.cycle, fault, magnitude * {_ONSET} AS f
    FROM scored s JOIN inj i ON s.subset = i.subset AND s.split = i.split AND s.engine_id = i.engine_id
      AND s.cycle >= i.injected_at_cycle) GROUP BY ALL),
over AS (SELECT l.*, {rnd(' + '.join(f'abs(coalesce(e_{s}, 0e0))' for s in _AFFECTED), 9)} AS mag,
    {', '.join(f'coalesce(e_{s}, 0e0) AS f_{s}' for s in _SHIFTED)}, anomaly_score
  FROM lab l JOIN scored USING ({UNIT}, cycle) LEFT JOIN eff USING ({UNIT}, cycle)),
fin AS (SELECT {K}, {', '.join(f"{s} + f_{s} * (SELECT any_value(std) FROM baseline b WHERE b.subset = o.subset AND sensor = '{s}') AS x_{s}" for s in _SHIFTED)},
    mag, {rnd(rnd('least(100e0, anomaly_score + mag * 12e0)', 6), 1)} AS faulted_score FROM over o)"""


def injections(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("bigint")
    errors = table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    return errors.withColumns(unit_columns(F.col("user_id"))).select(
        F.col("event_id").alias("injection_id"), *C.UNIT,
        F.get(F.array(*[F.lit(f) for f in _FAULT_NAMES]), F.pmod(k, F.lit(5)).cast("int")).alias("fault"),
        (F.lit(0.1) + k / F.lit(100.0)).alias("magnitude"), (k * 5 + 1).alias("injected_at_cycle"))


def _block(spark, sf_dir):
    return faults.BLOCK_CYCLES if hot_units(spark, sf_dir) else None


def _overlaid(spark, sf_dir):
    lab = labelled(spark, sf_dir)
    return faults.overlay_faults(
        scored(spark, sf_dir).drop("deviations", "ranked_sensors", "top_abnormal_sensors"), injections(spark, sf_dir),
        baseline_moments(train_rows(lab)), _block(spark, sf_dir))


@register("j9_fault_overlay", with_ctes(
    f"WITH {_OVERLAY} SELECT {K}, {', '.join(f'{rnd(f'x_{s}', 3)} AS {s}' for s in _SHIFTED)}, "
    f"{rnd('mag', 4)} AS fault_magnitude, faulted_score FROM fin", "scored", "lab", "baseline"))
def j9_fault_overlay(spark, sf_dir):
    out = _overlaid(spark, sf_dir)
    return out.select(*KEY, *[half_even(F.col(s), 3).alias(s) for s in _SHIFTED],
                      half_even(F.col("fault_magnitude"), 4).alias("fault_magnitude"), "faulted_score")


@register("j10_detection_latency", with_ctes(f"""WITH {_OVERLAY}
SELECT injection_id, i.subset, i.split, i.engine_id, fault, injected_at_cycle, min(cycle) AS detected_at_cycle,
  min(cycle) - injected_at_cycle AS latency_cycles
FROM inj i LEFT JOIN fin f ON i.subset = f.subset AND i.split = f.split AND i.engine_id = f.engine_id
  AND f.cycle >= injected_at_cycle AND faulted_score >= 60
GROUP BY injection_id, i.subset, i.split, i.engine_id, fault, injected_at_cycle""", "scored", "lab", "baseline"))
def j10_detection_latency(spark, sf_dir):
    return faults.detection_latency(
        injections(spark, sf_dir), _overlaid(spark, sf_dir), block=_block(spark, sf_dir)).drop("magnitude")


# --- intervals ----------------------------------------------------------------------------------
def u32(text, slot=0):
    return f"((CAST('0x' || substr(md5({text}), {1 + 8 * slot}, 8) AS BIGINT) + 0.5e0) / 4294967296e0)"


_FOLD = f"CAST(floor({u32("'fold:' || CAST(engine_id AS VARCHAR)")} * 5e0) AS INTEGER)"
_RESID = f"""fold AS (SELECT *, {_FOLD} AS fold FROM lab WHERE split = 'train'),
life AS (SELECT subset, fold, engine_id, max(cycle) AS life FROM fold GROUP BY ALL),
held AS (SELECT f.subset, f.fold, sum(life) AS s, count(*) AS n FROM (SELECT DISTINCT subset, fold FROM life) f
  JOIN life l ON f.subset = l.subset AND f.fold <> l.fold GROUP BY ALL),
pred AS (SELECT subset, RUL_capped, {rnd('least(greatest(CAST(s AS DOUBLE) / n - cycle, 0e0), 125e0)', 2)}
    AS predicted_RUL FROM fold JOIN held USING (subset, fold)),
resid AS (SELECT *, {rnd('RUL_capped - predicted_RUL', 2)} AS residual,
  CAST({' + '.join(f'CAST(predicted_RUL >= {e} AS INTEGER)' for e in (20, 40, 70, 100))} AS INTEGER) AS bin FROM pred),
offs AS (SELECT subset, bin, alpha, lo, hi FROM ({' UNION ALL '.join(
    f'SELECT subset, bin, {a}e0 AS alpha, quantile_cont(residual, {a / 2}) AS lo, quantile_cont(residual, {1 - a / 2}) '
    f'AS hi FROM resid GROUP BY ALL' for a in C.ALPHAS)})
  UNION ALL SELECT subset, CAST(bin AS INTEGER), alpha, -(5e0 + 4e0 * bin) * (1e0 + 0.1e0 / alpha), (5e0 + 4e0 * bin) * (1e0 + 0.1e0 / alpha)
  FROM (SELECT DISTINCT subset FROM fold WHERE subset NOT IN (SELECT subset FROM resid)), range(5) b(bin),
    (VALUES {', '.join(f'({a}e0)' for a in C.ALPHAS)}) v(alpha))"""


def hold_out_residuals(spark, sf_dir):
    """Residuals of training cycles, each predicted from the engines of the other folds."""
    lab = train_rows(labelled(spark, sf_dir, sensors=())).withColumn("fold", uncertainty.fold_of(F.col("engine_id")))
    lives = lab.groupBy("subset", "fold", "engine_id").agg(F.max("cycle").alias("life"))
    per_fold = lives.groupBy("subset", "fold").agg(F.sum("life").alias("s"), F.count(F.lit(1)).alias("n"))
    total = per_fold.groupBy("subset").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    # Both tables have one row per subset and fold.
    held = per_fold.join(F.broadcast(total), "subset").filter(F.col("tn") > F.col("n")).select(
        "subset", "fold", ((F.col("ts") - F.col("s")).cast("double") / (F.col("tn") - F.col("n"))).alias("mean_life"))
    predicted = half_even(clip(F.col("mean_life") - F.col("cycle"), 0.0, float(C.RUL_CAP)), 2)
    return lab.join(F.broadcast(held), ["subset", "fold"]).withColumn("predicted_RUL", predicted).select(
        "subset", "predicted_RUL", half_even(F.col("RUL_capped") - F.col("predicted_RUL"), 2).alias("residual"))


def _offsets(spark, sf_dir):
    """Fitted offsets; a subset whose engines are all in one fold has nothing held out and gets the default ones."""
    trained = train_rows(labelled(spark, sf_dir, sensors=()))
    return uncertainty.complete_offsets(uncertainty.fit_offsets(hold_out_residuals(spark, sf_dir)), trained)


@register("a18_conformal_offsets", with_ctes(
    f"WITH {_RESID} SELECT subset, bin, alpha, {rnd('lo', 4)} AS lo, {rnd('hi', 4)} AS hi FROM offs", "lab"))
def a18_conformal_offsets(spark, sf_dir):
    return rounded(_offsets(spark, sf_dir), 4)


@register("a17_interval_calibration", with_ctes(f"""WITH {_RESID},
iv AS (SELECT p.subset, p.alpha, p.true_RUL_capped AS t, greatest(p.predicted_RUL + coalesce(lo, -15e0), 0e0) AS low,
    p.predicted_RUL + coalesce(hi, 15e0) AS high FROM (
      SELECT l.*, a.alpha, CAST({' + '.join(f'CAST(predicted_RUL >= {e} AS INTEGER)' for e in (20, 40, 70, 100))}
        AS INTEGER) AS bin FROM lifepred l, (VALUES {', '.join(f'({a}e0)' for a in C.ALPHAS)}) a(alpha)
      WHERE split = 'test') p LEFT JOIN offs o ON p.subset = o.subset AND p.bin = o.bin AND p.alpha = o.alpha),
ag AS (SELECT subset, alpha, count(*) AS n, {rnd('count(*) FILTER (WHERE t BETWEEN low AND high) / CAST(count(*) AS DOUBLE)', 4)}
    AS coverage, {rnd('avg(high - low)', 2)} AS mean_interval_width FROM iv GROUP BY ALL)
SELECT subset, alpha, n, {rnd('(1e0 - alpha) * 100e0', 1)} AS nominal_coverage_pct,
  {rnd('coverage * 100e0', 1)} AS empirical_coverage_pct,
  {rnd(rnd('abs(coverage - (1e0 - alpha))', 4) + ' * 100e0', 1)} AS calibration_gap_pct, mean_interval_width FROM ag""",
    "lab", "lifepred"))
def a17_interval_calibration(spark, sf_dir):
    offsets = _offsets(spark, sf_dir)
    test = test_rows(life_predictions(spark, sf_dir)).drop("true_RUL").withColumnRenamed(
        "true_RUL_capped", "true_RUL")
    return uncertainty.calibration(test, offsets)


# --- fleet risk ---------------------------------------------------------------------------------
def _normal(text):
    return f"(sqrt(-2e0 * ln({u32(text, 0)})) * cos(6.283185307179586e0 * {u32(text, 1)}))"


_DRAW = f"""own AS (SELECT f.*, sim, greatest(predicted_RUL + {_normal("'42:' || CAST(engine_id AS VARCHAR) || ':' || CAST(sim AS VARCHAR)")}
    * (5e0 + 4e0 * ({' + '.join(f'CAST(predicted_RUL >= {e} AS INTEGER)' for e in (20, 40, 70, 100))})), 0e0) AS own
  FROM fleet f, range({C.N_SIMULATIONS}) r(sim)),
shock AS (SELECT sim, {_normal("'42:common:' || CAST(sim AS VARCHAR)")} AS z FROM range({C.N_SIMULATIONS}) r(sim)),
sd AS (SELECT subset, engine_id, stddev_pop(own) AS sd FROM own GROUP BY ALL),
draw AS (SELECT o.*, sd, greatest(own + 0.25e0 * sd * z, 0e0) AS draw FROM own o JOIN sd USING (subset, engine_id)
  JOIN shock USING (sim)),
cnt AS (SELECT subset, h.horizon_days, sim, count(*) FILTER (WHERE draw <= h.horizon_days * 2e0) AS down
  FROM draw, (VALUES (3), (7), (14), (30), (60)) h(horizon_days) GROUP BY ALL),
pf AS (SELECT subset, engine_id, h.horizon_days, any_value(engine_health_status) AS engine_health_status,
    any_value(predicted_RUL) AS predicted_RUL, any_value({S.subsystem_case('leading_sensor')}) AS subsystem,
    count(*) FILTER (WHERE draw <= h.horizon_days * 2e0) / {C.N_SIMULATIONS}e0 AS p
  FROM draw, (VALUES (3), (7), (14), (30), (60)) h(horizon_days) GROUP BY subset, engine_id, h.horizon_days)"""


@register("m6_failure_draws", with_ctes(
    f"WITH {_DRAW} SELECT subset, engine_id, horizon_days, {rnd('p', 4)} AS probability, subsystem FROM pf", "fleet"))
def m6_failure_draws(spark, sf_dir):
    out = risk.engine_failure(fleet(spark, sf_dir))
    return out.select("subset", "engine_id", "horizon_days", half_even(F.col("probability"), 4).alias("probability"),
                      "subsystem")


def _pct(test):
    return rnd(f"count(*) FILTER (WHERE {test}) / CAST(count(*) AS DOUBLE) * 100e0", 1)


@register("a19_horizon_summary", with_ctes(f"""WITH {_DRAW}
SELECT subset, horizon_days, CAST(horizon_days * 2 AS INTEGER) AS horizon_cycles,
  {_pct('down >= 1')} AS probability_any_grounding_pct, {_pct('down >= 2')} AS probability_two_or_more_pct,
  {rnd('avg(down)', 2)} AS expected_groundings,
  CAST(trunc(quantile_cont(CAST(down AS DOUBLE), 0.5)) AS INTEGER) AS p50_groundings,
  CAST(trunc(quantile_cont(CAST(down AS DOUBLE), 0.9)) AS INTEGER) AS p90_groundings,
  CAST(trunc(quantile_cont(CAST(down AS DOUBLE), 0.99)) AS INTEGER) AS worst_case_p99, 6 AS shop_capacity,
  {_pct('down > 6')} AS probability_over_capacity_pct,
  {rnd('avg(greatest(down - 6, 0))', 2)} AS expected_capacity_shortfall FROM cnt GROUP BY ALL""", "fleet"))
def a19_horizon_summary(spark, sf_dir):
    return risk.horizon_summary(risk.simulation_counts(fleet(spark, sf_dir)))


@register("a19_exceedance", with_ctes(f"""WITH {_DRAW},
top AS (SELECT subset, horizon_days, CAST(greatest(10, quantile_cont(CAST(down AS DOUBLE), 0.99) + 2) AS BIGINT) AS t
  FROM cnt GROUP BY ALL)
SELECT subset, horizon_days, at_least, {_pct('down >= at_least')} AS probability_pct FROM cnt
JOIN (SELECT subset, horizon_days, unnest(range(1, CAST(trunc(t) AS BIGINT) + 1)) AS at_least FROM top)
  USING (subset, horizon_days) GROUP BY ALL""".replace("CAST(greatest(10, quantile_cont(CAST(down AS DOUBLE), 0.99) + 2) AS BIGINT)", "greatest(10e0, quantile_cont(CAST(down AS DOUBLE), 0.99) + 2)"), "fleet"))
def a19_exceedance(spark, sf_dir):
    return risk.exceedance(risk.simulation_counts(fleet(spark, sf_dir)))


@register("a19_concentration", with_ctes(f"""WITH {_DRAW},
e AS (SELECT subset, horizon_days, subsystem, sum(p) AS v FROM pf GROUP BY ALL)
SELECT subset, horizon_days, subsystem, {rnd('v', 2)} AS expected_events,
  {rnd('v / t * 100e0', 1)} AS share_pct FROM (SELECT *, sum(v) OVER (PARTITION BY subset, horizon_days) AS t FROM e)
WHERE v > 0.005""", "fleet"))
def a19_concentration(spark, sf_dir):
    return risk.concentration(risk.engine_failure(fleet(spark, sf_dir)))


@register("a19_top_contributors", with_ctes(f"""WITH {_DRAW}
SELECT subset, horizon_days, row_number() OVER w AS rank, engine_id, printf('AE-%04d-', engine_id) ||
    CASE WHEN engine_id % 2 <> 0 THEN 'L' ELSE 'R' END AS engine_code, engine_health_status AS health_status,
  predicted_RUL, {rnd('p', 3)} AS failure_probability, subsystem FROM pf WHERE p > 0.01
WINDOW w AS (PARTITION BY subset, horizon_days ORDER BY {rnd('p', 3)} DESC, engine_id)
QUALIFY row_number() OVER w <= 12""", "fleet"))
def a19_top_contributors(spark, sf_dir):
    return risk.top_contributors(risk.engine_failure(fleet(spark, sf_dir)))
