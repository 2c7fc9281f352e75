"""Queries over explanation, decision, advisory and economics operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from bladewatch import constants as C
from bladewatch.catalog import inputs
from bladewatch.catalog import sql_base as S
from bladewatch.catalog.inputs import fleet, life_predictions, scored, test_rows, train_rows
from bladewatch.catalog.sql_base import UNIT, rnd, with_ctes
from bladewatch.functions import accuracy, advice, anomaly, economics, health
from bladewatch.functions.numeric import half_even
from bladewatch.operators import advisory, explain, lookup, registry, rul
from bladewatch.operators.features import engine_tail
from bladewatch.operators.ranks import exact_percentiles
from bladewatch.operators.stats import baseline_moments, lifetimes, used_sensors
from bladewatch.session import scratch_path
from bladewatch.sources.stages import export_documents, load_documents, materialise
from bladewatch.sources.supplied import labelled, table, unit_columns

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


def _rul():
    return F.col("predicted_RUL")


def _score():
    return F.col("anomaly_score")


# --- scalar scores ------------------------------------------------------------------------------
def _clip(expr):
    return f"least(greatest({expr}, 0e0), 100e0)"


_EXP = "100e0 * (1 - exp(-predicted_RUL / 62.5e0)) / (1 - exp(-2e0))"


@register("e3_health_score", with_ctes(
    f"SELECT {K}, {rnd(_clip('predicted_RUL / 125e0 * 100e0'), 4)} AS linear, {rnd(_clip(_EXP), 4)} AS exponential "
    f"FROM lifepred", "lifepred"))
def e3_health_score(spark, sf_dir):
    return life_predictions(spark, sf_dir).select(
        *KEY, half_even(health.health_score(_rul()), 4).alias("linear"),
        half_even(health.health_score(_rul(), mode="exponential"), 4).alias("exponential"))


@register("e4_health_stage", with_ctes(
    f"SELECT {K}, {S.steps(C.HEALTH_STAGES, _clip('predicted_RUL / 125e0 * 100e0'))} AS stage FROM lifepred",
    "lifepred"))
def e4_health_stage(spark, sf_dir):
    return life_predictions(spark, sf_dir).select(*KEY, health.health_stage(health.health_score(_rul())).alias("stage"))


@register("e5_health_columns", with_ctes(
    f"SELECT {K}, predicted_RUL, {rnd(_clip('predicted_RUL / 125e0 * 100e0'), 2)} AS health_score, "
    f"{S.steps(C.HEALTH_STAGES, _clip('predicted_RUL / 125e0 * 100e0'))} AS health_status FROM lifepred", "lifepred"))
def e5_health_columns(spark, sf_dir):
    return advisory.add_health_scores(life_predictions(spark, sf_dir)).select(
        *KEY, "predicted_RUL", "health_score", "health_status")


@register("e6_deviation_class", with_ctes(
    f"SELECT {K}, sensor, z2 AS z, {S.steps(C.DEVIATION_LEVELS, 'abs(z2)')} AS severity, "
    f"{S.steps(C.DEVIATION_LEVELS, 'abs(z2)', 2)} AS contribution FROM zrank", "zrank"))
def e6_deviation_class(spark, sf_dir):
    lab = labelled(spark, sf_dir)
    joined, z = explain.baseline_z(lab, baseline_moments(train_rows(lab)))
    pairs = F.array(*[F.struct(F.lit(s).alias("sensor"), half_even(v, 2).alias("z")) for s, v in z.items()])
    return joined.select(*KEY, F.inline(pairs)).filter("z is not null").select(
        *KEY, "sensor", "z", anomaly.deviation_severity(F.col("z")).alias("severity"),
        anomaly.deviation_contribution(F.col("z")).alias("contribution"))


@register("e7_anomaly_severity", with_ctes(f"SELECT {K}, anomaly_score, anomaly_severity FROM scored", "scored"))
def e7_anomaly_severity(spark, sf_dir):
    return scored(spark, sf_dir).select(*KEY, "anomaly_score", anomaly.anomaly_severity(_score()).alias("anomaly_severity"))


# A raw decision score for the calibration queries: half minus a two-hundredth of the rule score.
_RAW = f"SELECT {K}, split, 0.5e0 - anomaly_score / 200e0 AS raw FROM scored"
_BOUNDS = ("SELECT subset, quantile_cont(raw, 0.005) AS lo, quantile_cont(raw, 0.995) AS hi FROM r "
           "WHERE split = 'train' GROUP BY ALL")


def _raw_scores(spark, sf_dir):
    return scored(spark, sf_dir).withColumn("raw", F.lit(0.5) - _score() / F.lit(200.0))


def _raw_bounds(df):
    cut = exact_percentiles(train_rows(df), ["subset"], ["raw"], [0.005, 0.995])
    return cut.groupBy("subset").agg(F.max(F.when(F.col("p") == 0.005, F.col("value"))).alias("lo"),
                                     F.max(F.when(F.col("p") == 0.995, F.col("value"))).alias("hi"))


@register("a8_calibration_bounds", with_ctes(
    f"WITH r AS ({_RAW}) SELECT subset, {rnd('lo', 6)} AS raw_low, "
    f"{rnd('CASE WHEN hi <= lo THEN lo + 1 ELSE hi END', 6)} AS raw_high FROM ({_BOUNDS})", "scored"))
def a8_calibration_bounds(spark, sf_dir):
    low, high = F.col("lo"), F.col("hi")
    return _raw_bounds(_raw_scores(spark, sf_dir)).select(
        "subset", half_even(low, 6).alias("raw_low"),
        half_even(F.when(high <= low, low + 1.0).otherwise(high), 6).alias("raw_high"))


@register("e8_calibrated_score", with_ctes(
    f"WITH r AS ({_RAW}), b AS ({_BOUNDS}) SELECT {K}, {rnd(_clip('(hi - raw) / (hi - lo) * 100e0'), 2)} AS score "
    f"FROM r JOIN b USING (subset)", "scored"))
def e8_calibrated_score(spark, sf_dir):
    raw = materialise(_raw_scores(spark, sf_dir).select(*KEY, "raw"), "raw-scores")
    joined = raw.join(F.broadcast(_raw_bounds(raw)), "subset")
    return joined.select(*KEY, anomaly.calibrated_score(F.col("raw"), F.col("lo"), F.col("hi")).alias("score"))


@register("e9_anomaly_label", with_ctes(
    f"SELECT {K}, anomaly_score, CASE WHEN anomaly_score >= 60 OR max_sensor_deviation >= 2.3 THEN 'Anomalous' "
    f"ELSE 'Normal' END AS anomaly_label FROM scored", "scored"))
def e9_anomaly_label(spark, sf_dir):
    vote = F.when(F.col("max_sensor_deviation") >= 2.3, -1).otherwise(1)
    return scored(spark, sf_dir).select(*KEY, "anomaly_score", anomaly.anomaly_label(_score(), vote).alias("anomaly_label"))


_RANKS = ", ".join(
    f"top_sensor_{k}, top_sensor_{k}_zscore, top_sensor_{k}_abs_dev, "
    f"{S.steps(C.DEVIATION_LEVELS, f'abs(top_sensor_{k}_zscore)')} AS top_sensor_{k}_severity, "
    f"{S.steps(C.DEVIATION_LEVELS, f'abs(top_sensor_{k}_zscore)', 2)} AS top_sensor_{k}_contribution"
    for k in (1, 2, 3))


@register("e10_explain_anomalies", with_ctes(
    f"SELECT {K}, {_RANKS}, top_abnormal_sensors, max_sensor_deviation FROM expl", "expl"))
def e10_explain_anomalies(spark, sf_dir):
    lab = labelled(spark, sf_dir)
    out = explain.explain(lab, baseline_moments(train_rows(lab)))
    flat = explain.flatten_ranks(out)
    return flat.select(*KEY, *[c for c in flat.columns if c.startswith("top_")], "max_sensor_deviation")


@register("e11_simple_action", with_ctes(
    f"SELECT {K}, CASE " + " ".join(
        f"WHEN predicted_RUL <= {m} OR anomaly_score >= {a} THEN {S.q(t)}" for m, a, t in C.SIMPLE_ACTIONS)
    + f" ELSE {S.q(C.SIMPLE_ACTION_DEFAULT)} END AS recommended_action FROM scored", "scored"))
def e11_simple_action(spark, sf_dir):
    return scored(spark, sf_dir).select(*KEY, health.simple_action(_rul(), _score()).alias("recommended_action"))


_FLAG = "anomaly_label = 'Anomalous'"


@register("e12_health_status", with_ctes(
    f"SELECT {K}, engine_health_status, risk_level FROM assessed", "assessed"))
def e12_health_status(spark, sf_dir):
    decision = health.health_status(_rul(), _score(), F.col("anomaly_label"))
    return scored(spark, sf_dir).select(*KEY, decision["status"].alias("engine_health_status"),
                                        decision["risk"].alias("risk_level"))


@register("e13_composite_score", with_ctes(
    f"SELECT {K}, composite_health_score, {rnd(_clip('predicted_RUL / 125e0 * 100e0'), 2)} AS rul_component_score, "
    f"{rnd(_clip('100e0 - anomaly_score'), 2)} AS anomaly_component_score FROM assessed", "assessed"))
def e13_composite_score(spark, sf_dir):
    return scored(spark, sf_dir).select(
        *KEY, health.composite_score(_rul(), _score()).alias("composite_health_score"),
        half_even(health.rul_component(_rul()), 2).alias("rul_component_score"),
        half_even(health.anomaly_component(_score()), 2).alias("anomaly_component_score"))


_MARGIN = f"greatest(5e0, {rnd('predicted_RUL * 0.12e0', 1)})"


@register("e14_expected_range", with_ctes(
    f"SELECT {K}, greatest(0e0, {rnd(f'predicted_RUL - {_MARGIN}', 1)}) AS range_low, "
    f"{rnd(f'predicted_RUL + {_MARGIN}', 1)} AS range_high FROM lifepred", "lifepred"))
def e14_expected_range(spark, sf_dir):
    low, high = health.rul_range(_rul())
    return life_predictions(spark, sf_dir).select(*KEY, low.alias("range_low"), high.alias("range_high"))


_DIS = S.disagreement("predicted_RUL", "anomaly_score")
_CONF = rnd(f"100e0 - anomaly_score * 0.35e0 - CASE WHEN {_DIS} THEN 20e0 ELSE 0e0 END", 1)


@register("e15_confidence", with_ctes(
    f"SELECT {K}, least(greatest({_CONF}, 45e0), 98e0) AS confidence_pct FROM scored", "scored"))
def e15_confidence(spark, sf_dir):
    return scored(spark, sf_dir).select(*KEY, health.confidence(_rul(), _score()).alias("confidence_pct"))


_REASON = S.reason_case("engine_health_status", "predicted_RUL", "anomaly_score", "top_abnormal_sensors")


@register("e16_decision_reason", with_ctes(f"SELECT {K}, {_REASON} AS decision_reason FROM assessed", "assessed"))
def e16_decision_reason(spark, sf_dir):
    out = advisory.assess(scored(spark, sf_dir))
    return out.select(*KEY, "decision_reason")


@register("e17_assess_frame", with_ctes(
    f"SELECT {K}, engine_health_status, composite_health_score, risk_level, {_REASON} AS decision_reason "
    f"FROM assessed", "assessed"))
def e17_assess_frame(spark, sf_dir):
    return advisory.assess(scored(spark, sf_dir)).select(
        *KEY, "engine_health_status", "composite_health_score", "risk_level", "decision_reason")


_COMP, _SYS = S.components("top_abnormal_sensors"), S.systems("top_abnormal_sensors")


@register("e18_target_components", with_ctes(
    f"SELECT {K}, array_to_string({_COMP}, ', ') AS impacted_components, array_to_string({_SYS}, ', ') AS systems "
    f"FROM scored", "scored"))
def e18_target_components(spark, sf_dir):
    out = advice.with_targets(scored(spark, sf_dir), "top_abnormal_sensors")
    return out.select(*KEY, F.array_join("components", ", ").alias("impacted_components"),
                      F.array_join("systems", ", ").alias("systems"))


_ACTIONS = S.actions_case("engine_health_status", "comp", "sys")


@register("e19_action_items", with_ctes(
    f"SELECT {K}, {_ACTIONS} AS targeted_action_items FROM (SELECT *, {_COMP} AS comp, {_SYS} AS sys FROM assessed)",
    "assessed"))
def e19_action_items(spark, sf_dir):
    out = advisory.recommend(advisory.assess(scored(spark, sf_dir)))
    return out.select(*KEY, "targeted_action_items")


@register("e20_recommendation", with_ctes(
    f"SELECT {K}, {S.recommendation_case('engine_health_status')} AS maintenance_recommendation, "
    f"{S.urgency_case('engine_health_status', 'predicted_RUL')} AS urgency_window_cycles FROM assessed", "assessed"))
def e20_recommendation(spark, sf_dir):
    out = advisory.recommend(advisory.assess(scored(spark, sf_dir)))
    return out.select(*KEY, "maintenance_recommendation", "urgency_window_cycles")


_PRIO = rnd(_clip("100e0 - composite_health_score + anomaly_score * 0.3e0"), 1)


@register("e21_priority_index", with_ctes(f"SELECT {K}, {_PRIO} AS priority_score FROM assessed", "assessed"))
def e21_priority_index(spark, sf_dir):
    out = scored(spark, sf_dir)
    return out.select(*KEY, health.priority_index(health.composite_score(_rul(), _score()), _score()).alias("priority_score"))


_ECODE = "printf('AE-%04d-', engine_id) || CASE WHEN engine_id % 2 <> 0 THEN 'L' ELSE 'R' END"
_ACODE = "printf('AR-%03d', engine_id % 5 + 1)"


@register("e22_code_strings", with_ctes(
    f"SELECT {UNIT}, {_ECODE} AS engine_code, {_ACODE} AS aircraft_code FROM ends", "ends"))
def e22_code_strings(spark, sf_dir):
    engines = labelled(spark, sf_dir, sensors=()).select(*C.UNIT).distinct()
    return engines.select(*C.UNIT, advice.engine_code(F.col("engine_id")).alias("engine_code"),
                          advice.aircraft_code(F.col("engine_id")).alias("aircraft_code"))


def _sub(name, weight, floor):
    return rnd(f"least(greatest(100e0 - anomaly_score * {S.dbl(weight)}, {S.dbl(floor)}), 100e0)", 1) \
        + f" AS {name.lower()}"


@register("e23_subsystem_health", with_ctes(
    "WITH h AS (SELECT " + K + ", " + ", ".join(_sub(*s) for s in health.SUBSYSTEM_HEALTH) + " FROM scored) "
    "SELECT *, CASE least(compressor, turbine, thermal, pressure, mechanical) WHEN compressor THEN 'Compressor' "
    "WHEN turbine THEN 'Turbine' WHEN thermal THEN 'Thermal' WHEN pressure THEN 'Pressure' ELSE 'Mechanical' END "
    "AS weakest FROM h", "scored"))
def e23_subsystem_health(spark, sf_dir):
    out = scored(spark, sf_dir).withColumn("_h", health.subsystem_health(_score()))
    return out.select(*KEY, *[F.col("_h")[n].alias(n.lower()) for n, _, _ in health.SUBSYSTEM_HEALTH],
                      health.weakest_subsystem(_score())["name"].alias("weakest"))


# --- risk and cost ------------------------------------------------------------------------------
_RISK_BASE = f"""
base AS (SELECT f.*, leading_sensor AS primary_fault, {S.subsystem_case('leading_sensor')} AS subsystem,
  CASE WHEN latest_anomaly_score > 70 THEN greatest(p0, 0.65e0) ELSE p0 END AS probability FROM (
    SELECT *, CASE WHEN predicted_RUL < 60 THEN least(greatest((60e0 - predicted_RUL) / 60e0, 0e0), 1e0)
      ELSE 0.02e0 END AS p0 FROM fleet) f),
risk AS (SELECT *, [{', '.join(S.q(x) for x in C.SEVERITY_LEVELS)}][least(greatest(
      CASE aog_risk WHEN 'high' THEN 3 WHEN 'low' THEN 1 ELSE 2 END
      + CASE engine_health_status WHEN 'CRITICAL' THEN 1 WHEN 'HEALTHY' THEN -1 ELSE 0 END, 0), 4) + 1] AS severity,
    {S.steps(C.LIKELIHOOD_BOUNDS + ((0.0, 'Improbable'),), 'probability')} AS likelihood
  FROM base JOIN protocol USING (subsystem)),
rated AS (SELECT *, list_position([{', '.join(S.q(x) for x in C.SEVERITY_LEVELS)}], severity)
    * list_position([{', '.join(S.q(x) for x in C.LIKELIHOOD_LEVELS)}], likelihood) AS risk_score FROM risk),
costs AS (SELECT *, {S.steps(C.RISK_BANDS, 'risk_score')} AS risk_band,
    {S.steps(C.RISK_BANDS, 'risk_score', 2)} AS risk_action,
    round_even(labour_hours * 185e0, 0) AS labour_cost,
    round_even(150000e0 + labour_hours * 185e0, 0) AS planned_intervention_cost,
    round_even(450000e0 + 85000e0 * 2.5e0 + 0.35e0 * 220000e0 + 40000e0, 0) AS unplanned_event_cost,
    round_even(deferred, 0) AS expected_cost_if_deferred,
    round_even(deferred - (150000e0 + labour_hours * 185e0), 0) AS expected_saving,
    {rnd('predicted_RUL / 2e0', 1)} AS days_of_cover
  FROM (SELECT *, probability * (450000e0 + 85000e0 * 2.5e0 + 0.35e0 * 220000e0 + 40000e0)
    + (1e0 - probability) * 150000e0 AS deferred FROM rated))
"""


def _costs(spark, sf_dir):
    return advisory.economics(fleet(spark, sf_dir))


@register("e24_severity_level", with_ctes(f"WITH {_RISK_BASE} SELECT {UNIT}, subsystem, severity FROM risk",
                                          "fleet", "protocol"))
def e24_severity_level(spark, sf_dir):
    return _costs(spark, sf_dir).select(*C.UNIT, "subsystem", "severity")


@register("e25_likelihood", with_ctes(f"WITH {_RISK_BASE} SELECT {UNIT}, likelihood FROM risk", "fleet", "protocol"))
def e25_likelihood(spark, sf_dir):
    f = fleet(spark, sf_dir)
    p = economics.failure_probability(_rul(), F.col("latest_anomaly_score"))
    return f.select(*C.UNIT, economics.likelihood_name(p).alias("likelihood"))


@register("e26_risk_rating", with_ctes(
    f"WITH {_RISK_BASE} SELECT {UNIT}, severity, likelihood, risk_score, risk_band, risk_action FROM costs",
    "fleet", "protocol"))
def e26_risk_rating(spark, sf_dir):
    return _costs(spark, sf_dir).select(*C.UNIT, "severity", "likelihood", "risk_score", "risk_band", "risk_action")


_COST_COLUMNS = ("subsystem", "protocol_code", "labour_hours", "labour_cost", "planned_intervention_cost",
                 "unplanned_event_cost", "failure_probability", "expected_cost_if_deferred", "expected_saving",
                 "days_of_cover")


@register("e27_cost_analysis", with_ctes(
    f"WITH {_RISK_BASE} SELECT {UNIT}, {', '.join(c for c in _COST_COLUMNS if c != 'failure_probability')}, "
    f"{rnd('probability', 3)} AS failure_probability FROM costs", "fleet", "protocol"))
def e27_cost_analysis(spark, sf_dir):
    return _costs(spark, sf_dir).select(*C.UNIT, *_COST_COLUMNS)


@register("e28_failure_probability", with_ctes(
    f"WITH {_RISK_BASE} SELECT {UNIT}, {rnd('probability', 6)} AS probability FROM base", "fleet"))
def e28_failure_probability(spark, sf_dir):
    p = economics.failure_probability(_rul(), F.col("latest_anomaly_score"))
    return fleet(spark, sf_dir).select(*C.UNIT, half_even(p, 6).alias("probability"))


@register("a16_fleet_costs", with_ctes(f"""WITH {_RISK_BASE}
SELECT subset, count(*) AS total_engines,
  round_even(coalesce(sum(expected_saving) FILTER (WHERE expected_saving > 0), 0e0), 0) AS total_expected_savings,
  count(*) FILTER (WHERE expected_saving > 0) AS engines_worth_intervening,
  round_even(coalesce(sum(expected_saving) FILTER (WHERE expected_saving > 0), 0e0)
    / greatest(count(*) FILTER (WHERE expected_saving > 0), 1), 0) AS mean_saving_per_intervention,
  round_even(sum(expected_cost_if_deferred), 0) AS total_deferred_exposure,
  {', '.join(f"count(*) FILTER (WHERE risk_band = '{b}') AS band_{b.lower()}" for _, b, _ in C.RISK_BANDS)}
FROM costs GROUP BY ALL""", "fleet", "protocol"))
def a16_fleet_costs(spark, sf_dir):
    return advisory.cost_summary(_costs(spark, sf_dir))


@register("j6_sensor_dimension", with_ctes(
    f"SELECT {UNIT}, leading_sensor AS sensor, name, component, system FROM fleet LEFT JOIN sensordim "
    f"ON leading_sensor = sensor", "fleet", "sensordim"))
def j6_sensor_dimension(spark, sf_dir):
    dim = advisory.sensor_dim(spark).drop("position")
    leading = fleet(spark, sf_dir).select(*C.UNIT, F.col("leading_sensor").alias("sensor"))
    return leading.join(F.broadcast(dim), "sensor", "left")


@register("j7_protocol_lookup", with_ctes(f"""
SELECT {UNIT}, s.subsystem, coalesce(p.protocol_code, 'TASK-70-00-00') AS protocol_code,
  coalesce(p.labour_hours, 4e0) AS labour_hours, coalesce(p.aog_risk, 'low') AS aog_risk,
  coalesce(p.window_days, 14) AS window_days
FROM (SELECT {UNIT}, system AS subsystem FROM fleet LEFT JOIN sensordim ON leading_sensor = sensor) s
LEFT JOIN protocol p ON s.subsystem = p.subsystem""", "fleet", "sensordim", "protocol"))
def j7_protocol_lookup(spark, sf_dir):
    dim = advisory.sensor_dim(spark).select(F.col("sensor").alias("leading_sensor"), F.col("system").alias("subsystem"))
    systems = fleet(spark, sf_dir).join(F.broadcast(dim), "leading_sensor", "left").select(*C.UNIT, "subsystem")
    return advisory.with_protocol(systems).drop("protocol_title")


@register("j8_fault_subsystem", with_ctes(
    f"SELECT {K}, {S.subsystem_case('top_abnormal_sensors')} AS subsystem FROM scored", "scored"))
def j8_fault_subsystem(spark, sf_dir):
    return scored(spark, sf_dir).select(
        *KEY, advice.subsystem_of(F.col("top_abnormal_sensors")).alias("subsystem"))


# --- intervals and errors -----------------------------------------------------------------------
_BIN = "CAST(" + " + ".join(f"CAST(predicted_RUL >= {e} AS INTEGER)" for e in (20, 40, 70, 100)) + " AS INTEGER)"


@register("e29_rul_bin", with_ctes(f"SELECT {K}, {_BIN} AS bin FROM lifepred", "lifepred"))
def e29_rul_bin(spark, sf_dir):
    return life_predictions(spark, sf_dir).select(*KEY, accuracy.rul_bin(_rul()).alias("bin"))


@register("e30_predictive_interval", with_ctes(
    f"SELECT {K}, {rnd('greatest(predicted_RUL - w, 0e0)', 4)} AS lower, {rnd('predicted_RUL + w', 4)} AS upper "
    f"FROM (SELECT *, (5e0 + 4e0 * {_BIN}) * (1e0 + 0.1e0 / 0.1e0) AS w FROM lifepred)", "lifepred"))
def e30_predictive_interval(spark, sf_dir):
    from bladewatch.operators.uncertainty import add_interval, default_offsets

    out = add_interval(life_predictions(spark, sf_dir), default_offsets(spark), 0.1)
    return out.select(*KEY, half_even(F.col("lower"), 4).alias("lower"), half_even(F.col("upper"), 4).alias("upper"))


_NASA = ("CASE WHEN predicted_RUL - true_RUL < 0 THEN exp(-(predicted_RUL - true_RUL) / 13e0) - 1e0 "
         "ELSE exp((predicted_RUL - true_RUL) / 10e0) - 1e0 END")


@register("e31_nasa_penalty", with_ctes(
    f"SELECT {K}, {rnd(_NASA.replace('true_RUL', 'true_RUL_capped'), 4)} AS penalty FROM lifepred", "lifepred"))
def e31_nasa_penalty(spark, sf_dir):
    return life_predictions(spark, sf_dir).select(
        *KEY, half_even(accuracy.nasa_penalty(F.col("true_RUL_capped"), _rul()), 4).alias("penalty"))


@register("e32_absolute_error", with_ctes(
    f"SELECT {K}, {rnd('abs(predicted_RUL - true_RUL)', 2)} AS absolute_error FROM lifepred", "lifepred"))
def e32_absolute_error(spark, sf_dir):
    return life_predictions(spark, sf_dir).select(
        *KEY, accuracy.absolute_error(F.col("true_RUL"), _rul()).alias("absolute_error"))


# --- what-if and ad-hoc scoring -----------------------------------------------------------------
_SCEN = f"""scen AS (SELECT {UNIT}, predicted_RUL AS current_rul, latest_anomaly_score AS current_anomaly,
  predicted_RUL / 2e0 AS simulated_rul, least(100e0, latest_anomaly_score + 30e0) AS simulated_anomaly,
  top_abnormal_sensors AS simulated_sensors FROM fleet),
pair AS (SELECT *, {S.status_case('current_rul', 'current_anomaly', 'false', 0)} AS before_status,
  {S.status_case('current_rul', 'current_anomaly', 'false', 1)} AS before_risk,
  {S.composite('current_rul', 'current_anomaly')} AS before_composite,
  {S.status_case('simulated_rul', 'simulated_anomaly', 'false', 0)} AS after_status,
  {S.status_case('simulated_rul', 'simulated_anomaly', 'false', 1)} AS after_risk,
  {S.composite('simulated_rul', 'simulated_anomaly')} AS after_composite,
  {S.components('simulated_sensors')} AS comp, {S.systems('simulated_sensors')} AS sys FROM scen)"""
_SIM_CONF = rnd("100e0 - simulated_anomaly * 0.35e0 - CASE WHEN "
                + S.disagreement("simulated_rul", "simulated_anomaly") + " THEN 20e0 ELSE 0e0 END", 1)


@register("e33_what_if", with_ctes(f"""WITH {_SCEN}
SELECT * EXCLUDE (comp, sys), least(greatest({_SIM_CONF}, 45e0), 98e0) AS after_confidence,
  {S.reason_case('after_status', 'simulated_rul', 'simulated_anomaly', 'simulated_sensors')} AS after_reason,
  {S.recommendation_case('after_status')} AS after_recommendation,
  {S.actions_case('after_status', 'comp', 'sys')} AS after_actions,
  {S.urgency_case('after_status', 'simulated_rul')} AS after_urgency FROM pair""", "fleet"))
def e33_what_if(spark, sf_dir):
    scenarios = fleet(spark, sf_dir).select(
        *C.UNIT, _rul().alias("current_rul"), F.col("latest_anomaly_score").alias("current_anomaly"),
        (_rul() / 2.0).alias("simulated_rul"),
        F.least(F.lit(100.0), F.col("latest_anomaly_score") + 30.0).alias("simulated_anomaly"),
        F.col("top_abnormal_sensors").alias("simulated_sensors"))
    return advisory.compare_scenarios(scenarios)


def request_sql(source):
    """Expected scoring of (event_id, engine_id, predicted_RUL, anomaly_score, anomaly_label) rows."""
    status = S.status_case("predicted_RUL", "anomaly_score", _FLAG, 0)
    return f"""WITH req AS ({source}), st AS (SELECT *, {status} AS engine_health_status,
      {S.status_case('predicted_RUL', 'anomaly_score', _FLAG, 1)} AS risk_level,
      {S.components('top_abnormal_sensors')} AS comp, {S.systems('top_abnormal_sensors')} AS sys FROM req)
    SELECT event_id, engine_id, predicted_RUL, anomaly_score, anomaly_label, top_abnormal_sensors,
      engine_health_status, risk_level, {S.composite('predicted_RUL', 'anomaly_score')} AS composite_health_score,
      {_REASON} AS decision_reason, {S.recommendation_case('engine_health_status')} AS maintenance_recommendation,
      {_ACTIONS} AS targeted_action_items, array_to_string(comp, ', ') AS impacted_components,
      {S.urgency_case('engine_health_status', 'predicted_RUL')} AS urgency_window_cycles,
      least(greatest({_CONF}, 45e0), 98e0) AS confidence_pct,
      greatest(0e0, {rnd(f'predicted_RUL - {_MARGIN}', 1)}) AS expected_rul_low,
      {rnd(f'predicted_RUL + {_MARGIN}', 1)} AS expected_rul_high,
      predicted_RUL >= 60 AND anomaly_score >= 75 AS is_unknown_behaviour, {_DIS} AS is_model_disagreement FROM st"""


EVENT_REQUESTS = """SELECT event_id, user_id + 1 AS engine_id, least(value, 125e0) AS predicted_RUL,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS anomaly_score,
  CASE WHEN CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 60 THEN 'Anomalous' ELSE 'Normal' END AS anomaly_label,
  '' AS top_abnormal_sensors FROM events"""


@register("e34_score_requests", request_sql(EVENT_REQUESTS))
def e34_score_requests(spark, sf_dir):
    from bladewatch.streaming.telemetry import as_readings, score_stream

    return score_stream(as_readings(table(spark, sf_dir, "events")))


# --- anomaly summaries --------------------------------------------------------------------------
_SUMMARY = f"""summ AS (
  SELECT {UNIT}, max(cycle) AS last_observed_cycle, arg_max(anomaly_score, cycle) AS final_anomaly_score,
    arg_max(anomaly_severity, cycle) AS final_anomaly_severity, arg_max(anomaly_label, cycle) AS final_anomaly_status,
    count(*) AS total_cycles_observed, count(*) FILTER (WHERE {_FLAG}) AS total_anomalous_cycles,
    {rnd(f"count(*) FILTER (WHERE {_FLAG}) / CAST(count(*) AS DOUBLE) * 100e0", 2)} AS anomaly_cycle_ratio_pct,
    coalesce(min(cycle) FILTER (WHERE {_FLAG}), -1) AS first_anomalous_cycle FROM sc GROUP BY ALL),
lead AS (SELECT {UNIT}, string_agg(top_sensor_1, ', ' ORDER BY rk) AS names FROM (
    SELECT {UNIT}, top_sensor_1, row_number() OVER (PARTITION BY {UNIT}
      ORDER BY count(*) DESC, CAST(substr(top_sensor_1, 8) AS INTEGER)) AS rk
    FROM sc WHERE {_FLAG} GROUP BY {UNIT}, top_sensor_1) WHERE rk <= 2 GROUP BY ALL),
esum AS (SELECT summ.*, coalesce(names, 'None (Nominal)') AS top_degraded_sensors
  FROM summ LEFT JOIN lead USING ({UNIT}))"""
_SC = "sc AS (SELECT * FROM scored)"
_SC_TEST = "sc AS (SELECT * FROM scored WHERE split = 'test')"


@register("a11_engine_summary", with_ctes(f"WITH {_SC}, {_SUMMARY} SELECT * FROM esum", "scored"))
def a11_engine_summary(spark, sf_dir):
    return explain.engine_summary(scored(spark, sf_dir))


_RANKING = f"""
tot AS (SELECT subset, count(*) FILTER (WHERE {_FLAG}) AS hits, count(*) AS n FROM sc GROUP BY ALL),
ranking AS (SELECT u.subset, u.sensor,
    count(*) FILTER (WHERE top_sensor_1 = sensor AND (hits = 0 OR {_FLAG})) AS top_1_abnormal_count,
    count(*) FILTER (WHERE sensor IN (top_sensor_1, top_sensor_2, top_sensor_3) AND (hits = 0 OR {_FLAG}))
      AS top_3_abnormal_count,
    {rnd(f"count(*) FILTER (WHERE top_sensor_1 = sensor AND (hits = 0 OR {_FLAG})) / CAST(any_value(CASE WHEN hits > 0 THEN hits ELSE n END) AS DOUBLE) * 100e0", 2)} AS top_1_frequency_pct
  FROM usable u JOIN sc USING (subset) JOIN tot USING (subset) GROUP BY ALL)"""


def _ranking(spark, sf_dir):
    out = scored(spark, sf_dir)
    return explain.fleet_sensor_ranking(test_rows(out), used_sensors(train_rows(labelled(spark, sf_dir))))


@register("a12_fleet_sensor_ranking", with_ctes(f"WITH {_SC_TEST}, {_RANKING} SELECT * FROM ranking", "scored", "usable"))
def a12_fleet_sensor_ranking(spark, sf_dir):
    return _ranking(spark, sf_dir)


@register("o3_top_sensors", with_ctes(
    f"WITH {_SC_TEST}, {_RANKING} SELECT *, row_number() OVER (PARTITION BY subset ORDER BY top_1_abnormal_count DESC, "
    f"CAST(substr(sensor, 8) AS INTEGER)) AS rank FROM ranking QUALIFY row_number() OVER (PARTITION BY subset ORDER BY top_1_abnormal_count DESC, "
    f"CAST(substr(sensor, 8) AS INTEGER)) <= 5", "scored", "usable"))
def o3_top_sensors(spark, sf_dir):
    return explain.top_sensors(_ranking(spark, sf_dir), 5)


@register("a13_report_documents", with_ctes(f"""WITH {_SC_TEST}, {_RANKING},
top AS (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY top_1_abnormal_count DESC, CAST(substr(sensor, 8) AS INTEGER))
  AS rank FROM ranking),
c AS (SELECT subset, count(*) AS total_test_cycles, count(*) FILTER (WHERE {_FLAG}) AS anomalous_cycles_count FROM sc GROUP BY ALL)
SELECT subset, total_test_cycles, anomalous_cycles_count, rank, sensor, top_1_frequency_pct, top_1_abnormal_count
FROM top JOIN c USING (subset) WHERE rank <= 5""", "scored", "usable"))
def a13_report_documents(spark, sf_dir):
    """The anomaly report as one JSON document per subset, its top sensors inside; written, read back and taken apart."""
    test = test_rows(scored(spark, sf_dir))
    used = used_sensors(train_rows(labelled(spark, sf_dir)))
    report = explain.report_document(
        explain.anomaly_report(test, explain.engine_summary(test)), explain.fleet_sensor_ranking(test, used))
    path = scratch_path(spark, "reports")
    export_documents(report, path, "anomaly_report")
    back = load_documents(spark, path, "anomaly_report", report.schema)
    return back.select("subset", "total_test_cycles", "anomalous_cycles_count", F.posexplode("top_contributing_sensors").alias(
        "at", "s")).select("subset", "total_test_cycles", "anomalous_cycles_count", (F.col("at") + 1).alias("rank"), "s.*")


_SEV = {s: s.lower().replace(" ", "_") for _, s in C.ANOMALY_SEVERITIES}


@register("a13_anomaly_report", with_ctes(f"""WITH {_SC_TEST}, {_SUMMARY},
c AS (SELECT subset, count(*) AS total_test_cycles, count(*) FILTER (WHERE {_FLAG}) AS anomalous_cycles_count,
    {rnd(f"count(*) FILTER (WHERE {_FLAG}) / CAST(count(*) AS DOUBLE) * 100e0", 2)} AS anomalous_cycles_pct,
    {rnd('avg(anomaly_score)', 2)} AS mean_anomaly_score_fleet,
    {', '.join(f"count(*) FILTER (WHERE anomaly_severity = {S.q(s)}) AS {n}" for s, n in _SEV.items())}
  FROM sc GROUP BY ALL),
e AS (SELECT subset, count(*) AS total_test_engines,
    count(*) FILTER (WHERE total_anomalous_cycles > 0) AS engines_exhibiting_anomalies_count,
    {rnd("count(*) FILTER (WHERE total_anomalous_cycles > 0) / CAST(count(*) AS DOUBLE) * 100e0", 2)}
      AS engines_exhibiting_anomalies_pct,
    {rnd('avg(final_anomaly_score)', 2)} AS mean_anomaly_score_last_cycle FROM esum GROUP BY ALL)
SELECT * FROM c JOIN e USING (subset)""", "scored"))
def a13_anomaly_report(spark, sf_dir):
    test = test_rows(scored(spark, sf_dir))
    report = explain.anomaly_report(test, explain.engine_summary(test))
    histogram = {n: F.col("severity_distribution")[s] for s, n in _SEV.items()}
    return report.withColumns(histogram).drop("severity_distribution")


# --- integration --------------------------------------------------------------------------------
@register("j3_rul_anomaly_join", with_ctes(f"""WITH {_SC_TEST}, {_SUMMARY}
SELECT {UNIT}, p.cycle AS last_observed_cycle, p.predicted_RUL, final_anomaly_score, final_anomaly_severity,
  final_anomaly_status, anomaly_cycle_ratio_pct, top_degraded_sensors,
  CASE {' '.join(f"WHEN p.predicted_RUL <= {m} OR final_anomaly_score >= {a} THEN {S.q(t)}" for m, a, t in C.SIMPLE_ACTIONS)}
    ELSE {S.q(C.SIMPLE_ACTION_DEFAULT)} END AS recommended_action
FROM (SELECT * FROM lastpred WHERE split = 'test') p LEFT JOIN esum USING ({UNIT})""", "scored", "lastpred"))
def j3_rul_anomaly_join(spark, sf_dir):
    predictions = test_rows(inputs.last_predictions(spark, sf_dir)).select(
        *C.UNIT, F.col("cycle").alias("last_observed_cycle"), "predicted_RUL")
    summary = explain.engine_summary(test_rows(scored(spark, sf_dir)))
    return advisory.merge_rul_and_anomaly(predictions, summary)


_CYCLE = f"""SELECT {K}, predicted_RUL, {rnd(_clip('predicted_RUL / 125e0 * 100e0'), 2)} AS rul_health_score,
  anomaly_score, anomaly_label, anomaly_severity, max_sensor_deviation, engine_health_status, composite_health_score,
  risk_level, {S.urgency_case('engine_health_status', 'predicted_RUL')} AS urgency_window_cycles FROM assessed"""


@register("j4_cycle_advisory", with_ctes(_CYCLE, "assessed"))
def j4_cycle_advisory(spark, sf_dir):
    out = advisory.cycle_advisory(scored(spark, sf_dir))
    return out.select(*KEY, "predicted_RUL", "rul_health_score", "anomaly_score", "anomaly_label", "anomaly_severity",
                      "max_sensor_deviation", "engine_health_status", "composite_health_score", "risk_level",
                      "urgency_window_cycles")


_TEXTS = ("decision_reason", "maintenance_recommendation", "targeted_action_items", "impacted_components")


@register("j4_full_advisory", with_ctes(f"""
SELECT {K}, true_RUL, top_abnormal_sensors, {_RANKS}, {_REASON} AS decision_reason,
  {S.recommendation_case('engine_health_status')} AS maintenance_recommendation, {_ACTIONS} AS targeted_action_items,
  array_to_string(comp, ', ') AS impacted_components FROM (SELECT *, {_COMP} AS comp, {_SYS} AS sys FROM assessed)""", "assessed"))
def j4_full_advisory(spark, sf_dir):
    """The texts and sensor ranks of every cycle's advisory, beside the numbers of ``j4_cycle_advisory``."""
    out = explain.flatten_ranks(advisory.cycle_advisory(scored(spark, sf_dir)))
    ranks = [c for c in out.columns if c.startswith("top_sensor_")]
    return out.select(*KEY, "true_RUL", "top_abnormal_sensors", *ranks, *_TEXTS)


_FLEET_REASON = S.reason_case("engine_health_status", "predicted_RUL", "latest_anomaly_score", "top_abnormal_sensors")
_FLEET = f"""SELECT * EXCLUDE (comp, sys), {S.recommendation_case('engine_health_status')} AS
    maintenance_recommendation, {_FLEET_REASON} AS decision_reason, {_ACTIONS} AS targeted_action_items,
  array_to_string(comp, ', ') AS impacted_components,
  {S.urgency_case('engine_health_status', 'predicted_RUL')} AS urgency_window_cycles,
  {S.q(C.DISCLAIMER)} AS disclaimer FROM (SELECT *, {_COMP} AS comp, {_SYS} AS sys FROM fleet)"""


@register("p9_fleet_advisory", with_ctes(_FLEET, "fleet"))
def p9_fleet_advisory(spark, sf_dir):
    return fleet(spark, sf_dir)


_STAT = "count(*) FILTER (WHERE engine_health_status = {s})"
_SLUG = (("HEALTHY", "healthy"), ("MONITOR", "monitor"), ("MAINTENANCE REQUIRED", "maintenance"),
         ("CRITICAL", "critical"))


@register("a14_executive_report", with_ctes(f"""
SELECT * FROM (SELECT subset, count(*) AS total_fleet_engines,
  {', '.join(f"count(*) FILTER (WHERE engine_health_status = '{s}') AS {n}_count" for s, n in _SLUG)},
  {', '.join(rnd(f"count(*) FILTER (WHERE engine_health_status = '{s}') / CAST(count(*) AS DOUBLE) * 100e0", 1) + f" AS {n}_pct" for s, n in _SLUG)},
  count(*) FILTER (WHERE engine_health_status IN ('UNKNOWN BEHAVIOUR', 'MODEL DISAGREEMENT')) AS other_count,
  {', '.join(f"count(*) FILTER (WHERE risk_level = '{r}') AS risk_{r.lower()}" for r in ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL'))},
  {rnd('avg(predicted_RUL)', 2)} AS mean_predicted_rul, {rnd('avg(latest_anomaly_score)', 2)} AS mean_anomaly_score,
  {rnd('avg(composite_health_score)', 2)} AS mean_composite_health FROM fleet GROUP BY ALL)
JOIN (SELECT subset, count(*) AS total_cycles_evaluated FROM scored WHERE split = 'test' GROUP BY ALL) USING (subset)""",
    "fleet", "scored"))
def a14_executive_report(spark, sf_dir):
    cycles = test_rows(labelled(spark, sf_dir, sensors=()))
    return advisory.executive_report(fleet(spark, sf_dir), cycles)


@register("a14_flagged_engines", with_ctes(
    "SELECT subset, engine_health_status AS list, engine_id FROM fleet WHERE engine_health_status IN "
    "('CRITICAL', 'MAINTENANCE REQUIRED')", "fleet"))
def a14_flagged_engines(spark, sf_dir):
    return advisory.flagged_engines(fleet(spark, sf_dir))


@register("a15_fleet_summary", with_ctes(f"""
SELECT subset, count(*) AS total_engines, {_STAT.format(s="'HEALTHY'")} AS healthy,
  {_STAT.format(s="'MONITOR'")} AS monitor, {_STAT.format(s="'MAINTENANCE REQUIRED'")} AS maintenance_required,
  {_STAT.format(s="'CRITICAL'")} AS critical,
  count(*) FILTER (WHERE engine_health_status NOT IN ({', '.join(repr(s) for s in C.STATUSES)})) AS other,
  {rnd('avg(predicted_RUL)', 2)} AS mean_predicted_rul,
  {rnd('avg(latest_anomaly_score)', 2)} AS mean_anomaly_score,
  {rnd('avg(composite_health_score)', 2)} AS mean_composite_health FROM fleet GROUP BY ALL""", "fleet"))
def a15_fleet_summary(spark, sf_dir):
    return advisory.fleet_summary(fleet(spark, sf_dir))


_RANKED = f"""SELECT {UNIT}, {_ECODE} AS engine_code, {_ACODE} AS aircraft_code, latest_observed_cycle, predicted_RUL,
  latest_anomaly_score, engine_health_status, composite_health_score, risk_level,
  {rnd(_clip('100e0 - composite_health_score + latest_anomaly_score * 0.3e0'), 1)} AS priority_score,
  leading_sensor AS primary_fault FROM fleet"""


@register("a15_priority_ranking", with_ctes(_RANKED, "fleet"))
def a15_priority_ranking(spark, sf_dir):
    return advisory.priority_ranking(fleet(spark, sf_dir))


# --- searches -----------------------------------------------------------------------------------
@register("p10_engine_search", with_ctes(
    f"SELECT * FROM ({_RANKED}) WHERE contains(CAST(engine_id AS VARCHAR), '5-l') OR contains(lower(engine_code), "
    f"'5-l')", "fleet"))
def p10_engine_search(spark, sf_dir):
    return lookup.search_engines(advisory.priority_ranking(fleet(spark, sf_dir)), "5-L")


@register("p11_engine_lookup", with_ctes(f"""
SELECT r.engine_id, subset, engine_health_status, composite_health_score,
  CASE WHEN subset IS NULL THEN 'not found' ELSE 'found' END AS result
FROM (SELECT DISTINCT user_id + 1 AS engine_id FROM events) r LEFT JOIN fleet f ON r.engine_id = f.engine_id""",
    "fleet"))
def p11_engine_lookup(spark, sf_dir):
    requests = table(spark, sf_dir, "events").select((F.col("user_id") + 1).alias("engine_id")).distinct()
    slim = fleet(spark, sf_dir).select("engine_id", "subset", "engine_health_status", "composite_health_score")
    return lookup.find_engines(slim, requests)


@register("p12_engine_history", with_ctes(
    f"SELECT {K}, predicted_RUL, anomaly_score, anomaly_label, engine_health_status, composite_health_score, "
    f"count(*) OVER (PARTITION BY {UNIT}) AS total_cycles FROM assessed", "assessed"))
def p12_engine_history(spark, sf_dir):
    return lookup.engine_history(advisory.assess(scored(spark, sf_dir)))


ONE_ENGINE = 8  # that is looked up by itself


@register("p11_one_engine", with_ctes(
    f"SELECT engine_id, subset, latest_observed_cycle, predicted_RUL, engine_health_status, composite_health_score FROM fleet "
    f"WHERE engine_id = {ONE_ENGINE}", "fleet"))
def p11_one_engine(spark, sf_dir):
    """The advisory of one engine; the filter reaches the scan of the stage table."""
    return lookup.find_engine(fleet(spark, sf_dir, ONE_ENGINE), ONE_ENGINE).select(
        "engine_id", "subset", "latest_observed_cycle", "predicted_RUL", "engine_health_status", "composite_health_score")


@register("p12_one_engine", with_ctes(
    f"SELECT {K}, predicted_RUL, anomaly_score, anomaly_label, engine_health_status, composite_health_score, "
    f"count(*) OVER (PARTITION BY {UNIT}) AS total_cycles FROM assessed WHERE engine_id = {ONE_ENGINE}", "assessed"))
def p12_one_engine(spark, sf_dir):
    """The trajectory of one engine, without a sort of all."""
    return lookup.engine_history(advisory.assess(scored(spark, sf_dir, ONE_ENGINE)), ONE_ENGINE)


@register("p13_sensor_explorer", with_ctes(f"""
WITH s AS (SELECT {UNIT}, sensor, arg_max(x, cycle) AS last_value, arg_max((x - mean) / std, cycle) AS z,
    CASE WHEN stddev_samp(x) > 0 THEN covar_samp(x, cycle) / var_samp(cycle) ELSE 0e0 END AS slope, max(cycle) - min(cycle) AS life,
    any_value(std) AS std FROM lablong LEFT JOIN baseline USING (subset, sensor) GROUP BY ALL)
SELECT {UNIT}, sensor, {rnd('last_value', 3)} AS last_value, {rnd('z', 2)} AS z_score, {rnd('slope', 6)} AS slope,
  CASE WHEN slope * life / std >= 0.5 THEN 'Increasing' WHEN slope * life / std <= -0.5 THEN 'Decreasing'
    WHEN abs({rnd('z', 2)}) >= 2 THEN 'Elevated' ELSE 'Stable' END AS trend FROM s""", "lablong", "baseline"))
def p13_sensor_explorer(spark, sf_dir):
    lab = labelled(spark, sf_dir)
    return lookup.sensor_explorer(lab, baseline_moments(train_rows(lab)))


# --- registry -----------------------------------------------------------------------------------
@register("r1_engine_registry", with_ctes(f"""
SELECT {_ECODE} AS engine_code, engine_id, subset, CASE WHEN engine_id = 1 THEN 'AR-042' ELSE {_ACODE} END
    AS aircraft_code, 'SN-CFM56-' || CAST(8000 + engine_id AS VARCHAR) AS serial_number,
  'Turbofan CFM56-7B' AS engine_model, CASE WHEN engine_id % 2 <> 0 THEN 'LEFT' ELSE 'RIGHT' END AS position,
  '2022-04-15' AS installation_date, latest_observed_cycle AS total_cycles,
  {rnd('latest_observed_cycle * 2.8e0', 1)} AS total_hours, predicted_RUL AS current_rul,
  composite_health_score AS health_index, engine_health_status AS status, risk_level,
  '2026-06-10' AS last_inspection, '2026-09-01' AS next_maintenance, leading_sensor AS primary_fault
FROM fleet""", "fleet"))
def r1_engine_registry(spark, sf_dir):
    return registry.engine_registry(fleet(spark, sf_dir))


# Work-order log from the event table: one order per user, each event a status change (fixed values).
_LOG_STATUS = {"signup": "OPEN", "view": "IN_PROGRESS", "click": "IN_PROGRESS", "error": "ON_HOLD",
               "purchase": "COMPLETED"}


def _log(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    status = F.create_map(*[F.lit(x) for pair in _LOG_STATUS.items() for x in pair])
    return events.select(
        F.concat(F.lit("WO-"), (F.col("user_id") + 1000).cast("string")).alias("work_order_id"),
        (F.col("user_id") + 1).alias("engine_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"),
        F.col("event_id").alias("seq"), status[F.col("event_type")].alias("status"))


_LOG_SQL = f"""log AS (SELECT 'WO-' || CAST(user_id + 1000 AS VARCHAR) AS work_order_id, user_id + 1 AS engine_id,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS "at", event_id AS seq, CASE event_type
    {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _LOG_STATUS.items())} END AS status FROM events)"""
_ORDERS_SQL = f"""WITH {_LOG_SQL} SELECT *, min("at") OVER w AS created_at, count(*) OVER w AS changes FROM log
WINDOW w AS (PARTITION BY work_order_id)
QUALIFY row_number() OVER (PARTITION BY work_order_id ORDER BY "at" DESC, seq DESC) = 1"""


@register("r2_current_work_orders", _ORDERS_SQL)
def r2_current_work_orders(spark, sf_dir):
    return registry.current_work_orders(_log(spark, sf_dir))


@register("r2_work_order_requests", with_ctes(f"""
SELECT {_ECODE} AS engine_code, {_ACODE} AS aircraft_code, maintenance_recommendation AS issue_summary,
  CASE WHEN engine_health_status = 'CRITICAL' THEN 'HIGH' ELSE 'MEDIUM' END AS priority,
  targeted_action_items AS recommended_action, urgency_window_cycles, 'OPEN' AS status
FROM ({_FLEET}) WHERE urgency_window_cycles >= 0""", "fleet"))
def r2_work_order_requests(spark, sf_dir):
    return registry.work_order_requests(fleet(spark, sf_dir))


_ALERTS = f"""SELECT {UNIT}, {_ECODE} AS engine_code, {_ACODE} AS aircraft_code, latest_observed_cycle,
  predicted_RUL AS predicted_rul, latest_anomaly_score AS anomaly_score, 'UNACKNOWLEDGED' AS status, a.* FROM (
  SELECT *, 'ANOMALY' AS alert_type, CASE WHEN latest_anomaly_score >= 80 THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
    'Elevated sensor deviation (score ' || {S.fmt1('latest_anomaly_score')} || '/100)' AS message FROM fleet
    WHERE latest_anomaly_score >= 65
  UNION ALL SELECT *, 'LOW_RUL', 'CRITICAL', 'End of life predicted (RUL ' || {S.fmt1('predicted_RUL')} || ' cycles)'
    FROM fleet WHERE predicted_RUL < 20)""".replace(", a.* FROM", ", alert_type, severity, message FROM")


@register("r3_alerts", with_ctes(_ALERTS, "fleet"))
def r3_alerts(spark, sf_dir):
    return registry.newest_first(registry.alerts(fleet(spark, sf_dir)), "latest_observed_cycle", "engine_id")


@register("o4_newest_first", _ORDERS_SQL)
def o4_newest_first(spark, sf_dir):
    orders = registry.current_work_orders(_log(spark, sf_dir))
    return registry.newest_first(orders, "created_at", "work_order_id")


@register("j5_aircraft_engines", f"""
WITH ac AS (SELECT n_nationkey AS home, n_name AS operator, r_name AS region FROM nation JOIN region
    ON n_regionkey = r_regionkey),
en AS (SELECT {S._UNITS.format(k='s_suppkey')}, s_nationkey AS home, s_name AS engine_name FROM supplier)
SELECT ac.home, operator, region, coalesce(n, 0) AS engine_count, subset, split, engine_id, engine_name
FROM ac LEFT JOIN (SELECT home, count(*) AS n FROM en GROUP BY ALL) c ON ac.home = c.home
LEFT JOIN en ON ac.home = en.home""")
def j5_aircraft_engines(spark, sf_dir):
    region = table(spark, sf_dir, "region")
    aircraft = table(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("home"), F.col("n_name").alias("operator"), F.col("r_name").alias("region"))
    engines = table(spark, sf_dir, "supplier").withColumns(unit_columns(F.col("s_suppkey"))).select(
        *C.UNIT, F.col("s_nationkey").alias("home"), F.col("s_name").alias("engine_name"))
    return registry.aircraft_with_engines(aircraft, engines, "home")


# --- evaluation ---------------------------------------------------------------------------------
def metrics_sql(source, scope, group="subset", truth="true_RUL"):
    t, p = truth, "predicted_RUL"
    return f"""SELECT {group}, count(*) AS n, {rnd(f'avg(abs({p} - {t}))', 4)} AS mae,
      {rnd(f'sqrt(avg(({p} - {t}) * ({p} - {t})))', 4)} AS rmse,
      {rnd(f'1e0 - sum(({p} - {t}) * ({p} - {t})) / nullif(var_pop({t}) * count(*), 0)', 4)} AS r2,
      {rnd(f'sum({_NASA.replace("true_RUL", truth)})', 2)} AS nasa_score, '{scope}' AS scope FROM {source} GROUP BY ALL"""


@register("a10_regression_metrics", with_ctes(
    metrics_sql("(SELECT * FROM lifepred WHERE split = 'test')", "all_cycles", truth="true_RUL_capped")
    + " UNION ALL " + metrics_sql("(SELECT * FROM lastpred WHERE split = 'test')", "last_cycle",
                                  truth="true_RUL_capped"), "lifepred", "lastpred"))
def a10_regression_metrics(spark, sf_dir):
    return rul.evaluate(test_rows(life_predictions(spark, sf_dir)), truth="true_RUL_capped")


# protocol: (test rows, training rows), both over ``lab``; the fifths are fixed by engine and cycle numbers
_FIFTH_CYCLE, _FIFTH_ENGINE = "(engine_id * 7 + cycle) % 5 = 0", "floor(engine_id / 8) % 5 = 0"
_PROTOCOLS = {
    "random_split": (f"split = 'train' AND {_FIFTH_CYCLE}", f"split = 'train' AND NOT ({_FIFTH_CYCLE})"),
    "engine_grouped": (f"split = 'train' AND {_FIFTH_ENGINE}", f"split = 'train' AND NOT ({_FIFTH_ENGINE})"),
    "official_test": ("split = 'test'", "split = 'train'"),
}
MAINTENANCE_TASK = 150.0


def _classified(protocol, test, train):
    counted = ", ".join(
        f"count(*) FILTER (WHERE true_RUL {t} 150 AND predicted_RUL {p} 150) AS {n}"
        for n, t, p in (("tp", "<", "<"), ("fp", ">=", "<"), ("fn", "<", ">="), ("tn", ">=", ">=")))
    return f"""SELECT '{protocol}' AS protocol, subset, count(*) AS n, {counted} FROM (
      SELECT subset, CAST(RUL AS DOUBLE) AS true_RUL, {rnd('greatest(mean_life - cycle, 0e0)', 2)} AS predicted_RUL
      FROM lab LEFT JOIN (SELECT subset, avg(life) AS mean_life FROM (
        SELECT subset, engine_id, max(cycle) AS life FROM lab WHERE {train} GROUP BY ALL) GROUP BY ALL) USING (subset)
      WHERE {test}) GROUP BY ALL"""


@register("a22_maintenance_classification", with_ctes(f"""
SELECT *, {rnd('(tp + tn) / CAST(n AS DOUBLE) * 100e0', 2)} AS accuracy_pct,
  {rnd('coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0e0) * 100e0', 2)} AS precision_pct,
  {rnd('coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0e0) * 100e0', 2)} AS recall_pct,
  {rnd('coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0e0) * 100e0', 2)} AS f1_pct
FROM ({' UNION ALL '.join(_classified(k, *v) for k, v in _PROTOCOLS.items())})""", "lab"))
def a22_maintenance_classification(spark, sf_dir):
    """RUL below 150 by mean lifetime minus cycle, uncapped, under the three ways to split."""
    lab, parts = labelled(spark, sf_dir, sensors=()), []
    for protocol, (test, train) in _PROTOCOLS.items():
        mean_life = lifetimes(lab.filter(train)).groupBy("subset").agg(F.avg("lifetime").alias("mean_life"))
        rows = lab.filter(test).join(mean_life, "subset", "left").select(
            "subset", F.col("RUL").cast("double").alias("true_RUL"),
            half_even(F.greatest(F.col("mean_life") - F.col("cycle"), F.lit(0.0)), 2).alias("predicted_RUL"))
        parts.append(rows.withColumn("protocol", F.lit(protocol)))
    return rul.maintenance_classification(
        parts[0].unionByName(parts[1]).unionByName(parts[2]), MAINTENANCE_TASK, ("protocol", "subset"))


@register("v15_parity", with_ctes(
    f"SELECT {UNIT}, true_RUL, predicted_RUL, abs(predicted_RUL - true_RUL) AS absolute_error FROM lastpred "
    f"WHERE split = 'test'", "lastpred"))
def v15_parity(spark, sf_dir):
    from bladewatch.operators.plotdata import parity

    return parity(engine_tail(test_rows(life_predictions(spark, sf_dir))))
