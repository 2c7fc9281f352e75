"""Shared common-table expressions of the oracle SQL, and the helper that strings them together.

The SQL states the expected result independently of the Spark code; only the fixed tables
(texts, tags, protocols, thresholds) come from ``constants``.
"""

from __future__ import annotations

import re

from bladewatch import constants as C

SENSORS = ("sensor_1", "sensor_2", "sensor_3", "sensor_4", "sensor_7", "sensor_8", "sensor_9", "sensor_11")
SETTINGS = ("setting_1", "setting_2", "setting_3")
FRAME = "subset, split"
UNIT = "subset, split, engine_id"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def dbl(value: float) -> str:
    return f"CAST({value!r} AS DOUBLE)"


def rnd(expr: str, digits: int) -> str:
    scale = float(10**digits)
    return f"(round_even(({expr}) * {dbl(scale)}, 0) / {dbl(scale)})"


def fmt1(expr: str) -> str:
    return f"printf('%.1f', {rnd(expr, 1)})"


def steps(levels, expr: str, position: int = 1) -> str:
    body = " ".join(f"WHEN {expr} >= {dbl(float(level[0]))} THEN {q(level[position])}" for level in levels[:-1])
    return f"CASE {body} ELSE {q(levels[-1][position])} END"


def values(rows) -> str:
    def cell(v):
        if isinstance(v, str):
            return q(v)
        return dbl(v) if isinstance(v, float) else str(v)

    return ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


def subsystem_case(expr: str) -> str:
    body = " ".join(f"WHEN contains(lower({expr}), {q(tag.lower())}) THEN {q(sub)}" for tag, sub in C.SUBSYSTEM_TAGS)
    return f"CASE {body} ELSE {q(C.DEFAULT_SUBSYSTEM)} END"


def composite(rul: str, anomaly: str) -> str:
    r = f"least(greatest({rul} / 125e0 * 100e0, 0e0), 100e0)"
    a = f"least(greatest(100e0 - {anomaly}, 0e0), 100e0)"
    return rnd(f"least(greatest(0.6e0 * {r} + 0.4e0 * {a}, 0e0), 100e0)", 2)


def disagreement(rul: str, anomaly: str) -> str:
    return f"(({rul} >= 70 AND {anomaly} >= 65) OR ({rul} <= 20 AND {anomaly} <= 30))"


def status_case(rul: str, anomaly: str, flagged: str, which: int) -> str:
    out = [("UNKNOWN BEHAVIOUR", "HIGH"), ("MODEL DISAGREEMENT", "HIGH"), ("CRITICAL", "CRITICAL"),
           ("MAINTENANCE REQUIRED", "HIGH"), ("MONITOR", "MEDIUM"), ("HEALTHY", "LOW")]
    tests = [f"{rul} >= 60 AND {anomaly} >= 75", disagreement(rul, anomaly), f"{rul} < 20 OR {anomaly} >= 80",
             f"{rul} < 45 OR {anomaly} >= 65", f"{rul} < 75 OR {anomaly} >= 45 OR {flagged}"]
    body = " ".join(f"WHEN {t} THEN {q(o[which])}" for t, o in zip(tests, out))
    return f"CASE {body} ELSE {q(out[-1][which])} END"


def has_text(expr: str) -> str:
    low = f"lower(coalesce({expr}, ''))"
    return f"({low} <> '' AND NOT contains({low}, 'nominal') AND NOT contains({low}, 'none'))"


def reason_case(status: str, rul: str, anomaly: str, text: str) -> str:
    clause = f"CASE WHEN {has_text(text)} THEN {q(C.SENSOR_CLAUSE)} || {text} ELSE '' END"

    def say(key: str) -> str:
        parts = re.split(r"(\{rul\}|\{anomaly\}|\{sensors\})", C.REASONS[key])
        names = {"{rul}": fmt1(rul), "{anomaly}": fmt1(anomaly), "{sensors}": f"({clause})"}
        return " || ".join(names.get(p, q(p)) for p in parts if p)

    return f"""CASE
      WHEN {status} = 'UNKNOWN BEHAVIOUR' THEN {say('unknown')}
      WHEN {status} = 'MODEL DISAGREEMENT' THEN {say('disagreement')}
      WHEN {status} = 'CRITICAL' AND {rul} < 20 AND {anomaly} >= 80 THEN {say('critical_both')}
      WHEN {status} = 'CRITICAL' AND {rul} < 20 THEN {say('critical_rul')}
      WHEN {status} = 'CRITICAL' THEN {say('critical_anomaly')}
      WHEN {status} = 'MAINTENANCE REQUIRED' AND {rul} < 45 AND {anomaly} >= 65 THEN {say('maintenance_both')}
      WHEN {status} = 'MAINTENANCE REQUIRED' AND {rul} < 45 THEN {say('maintenance_rul')}
      WHEN {status} = 'MAINTENANCE REQUIRED' THEN {say('maintenance_anomaly')}
      WHEN {status} = 'MONITOR' AND {anomaly} >= 45 THEN {say('monitor_anomaly')}
      WHEN {status} = 'MONITOR' THEN {say('monitor_rul')}
      ELSE {say('healthy')} END"""


def urgency_case(status: str, rul: str) -> str:
    return f"""CAST(CASE WHEN {status} = 'CRITICAL' THEN 0
      WHEN {status} = 'MAINTENANCE REQUIRED'
        THEN greatest(1, least(15, CASE WHEN {rul} > 5 THEN CAST(trunc({rul} - 5) AS INTEGER) ELSE 1 END))
      WHEN {status} = 'MONITOR'
        THEN greatest(5, least(30, CASE WHEN {rul} > 15 THEN CAST(trunc({rul} - 15) AS INTEGER) ELSE 5 END))
      ELSE -1 END AS INTEGER)"""


def recommendation_case(status: str) -> str:
    body = " ".join(f"WHEN {status} = {q(s)} THEN {q(C.RECOMMENDATIONS[s])}"
                    for s in ("CRITICAL", "MAINTENANCE REQUIRED", "MONITOR"))
    return f"CASE {body} ELSE {q(C.RECOMMENDATIONS['HEALTHY'])} END"


def component_list(text: str, position: int, nominal: str, untagged: str, unknown: str) -> str:
    table = "MAP {" + ", ".join(f"{q(r[0])}: {q(r[position])}" for r in C.SENSOR_DIM) + "}"
    tokens = f"regexp_extract_all({text}, 'sensor_\\d+')"
    names = f"list_filter(list_transform({tokens}, lambda t: {table}[t]), lambda n: n IS NOT NULL)"
    ordered = f"list_transform(list_filter(list_zip({names}, range(1, len({names}) + 1)), " \
              f"lambda e: list_position({names}, e[1]) = e[2]), lambda e: e[1])"
    return f"""CASE WHEN NOT {has_text(text)} THEN [{q(nominal)}]
      WHEN len({tokens}) = 0 THEN [{q(untagged)}]
      WHEN len({names}) = 0 THEN [{q(unknown)}] ELSE {ordered} END"""


def components(text: str) -> str:
    return component_list(text, 2, "All Subsystems Nominal", "General Telemetry", "General Subsystems")


def systems(text: str) -> str:
    return component_list(text, 3, "Nominal", "General Engine Health", "Core Gas Path")


def actions_case(status: str, comp: str, sys_: str) -> str:
    hay = f"lower(array_to_string(list_concat({comp}, {sys_}), ' '))"
    items = []
    for words, text in C.ACTION_ITEMS:
        hit = " OR ".join(f"contains({hay}, {q(w)})" for w in words)
        items.append(f"CASE WHEN {hit} THEN {q(text)} END")
    listed = f"list_filter([{', '.join(items)}], lambda a: a IS NOT NULL)"
    joined = f"CASE WHEN len({listed}) = 0 THEN {q(C.ACTION_DEFAULT)} ELSE array_to_string({listed}, ' | ') END"
    return f"""CASE WHEN {status} = 'HEALTHY' THEN {q(C.ACTION_HEALTHY)}
      WHEN {status} = 'CRITICAL' THEN {q(C.ACTION_GROUNDING + ' | ')} || {joined} ELSE {joined} END"""


def _long(source: str, columns, name: str, value: str, keys: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}, {q(c)} AS {name}, CAST({c} AS DOUBLE) AS {value} FROM {source}" for c in columns)


_UNITS = """'FD00' || CAST(1 + {k} % 4 AS VARCHAR) AS subset,
    CASE WHEN ({k} // 4) % 2 = 0 THEN 'train' ELSE 'test' END AS split,
    CAST({k} + 1 AS BIGINT) AS engine_id"""

_STATUS = status_case("predicted_RUL", "anomaly_score", "anomaly_label = 'Anomalous'", 0)
_RISK = status_case("predicted_RUL", "anomaly_score", "anomaly_label = 'Anomalous'", 1)

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "cyc": ((), f"""
    SELECT {_UNITS.format(k='l_suppkey')}, l.*,
      row_number() OVER (PARTITION BY l_suppkey
        ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS cycle
    FROM lineitem l"""),
    "tel": (("cyc",), """
    SELECT subset, split, engine_id, cycle, l_discount AS setting_1, l_tax AS setting_2,
      CAST(l_linenumber AS DOUBLE) AS setting_3,
      518.67e0 AS sensor_1, l_quantity AS sensor_2, l_extendedprice AS sensor_3, p_retailprice AS sensor_4,
      o_totalprice AS sensor_7, CAST(p_size AS DOUBLE) AS sensor_8, l_quantity + 0.05e0 * cycle AS sensor_9,
      l_extendedprice / l_quantity AS sensor_11
    FROM cyc LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN orders ON l_orderkey = o_orderkey"""),
    "truth": ((), f"""
    SELECT subset, row_number() OVER (PARTITION BY subset ORDER BY engine_id) AS engine_ordinal, true_rul
    FROM (SELECT {_UNITS.format(k='s_suppkey')}, CAST(floor(abs(s_acctbal)) AS BIGINT) % 146 AS true_rul
          FROM supplier) WHERE split = 'test'"""),
    "ends": (("cyc",), f"SELECT {UNIT}, max(cycle) AS last_cycle FROM cyc GROUP BY ALL"),
    "known": (("ends", "truth"), """
    SELECT e.*, CASE WHEN split = 'train' THEN 0 ELSE true_rul END AS true_rul FROM (
      SELECT *, row_number() OVER (PARTITION BY subset, split ORDER BY engine_id) AS engine_ordinal FROM ends) e
    LEFT JOIN truth t ON e.subset = t.subset AND e.engine_ordinal = t.engine_ordinal"""),
    "lab": (("tel", "known"), """
    SELECT t.*, CAST(k.true_rul + last_cycle - cycle AS BIGINT) AS RUL,
      CAST(least(k.true_rul + last_cycle - cycle, 125) AS BIGINT) AS RUL_capped
    FROM tel t JOIN known k USING (subset, split, engine_id)"""),
    "trainlong": (("lab",), _long("lab WHERE split = 'train'", SENSORS, "sensor", "x",
                                  "subset, engine_id, cycle, RUL_capped")),
    "usable": (("trainlong",), """
    SELECT subset, sensor FROM trainlong GROUP BY ALL HAVING var_samp(x) > 1e-3"""),
    "healthy": (("trainlong",), """
    SELECT l.* FROM trainlong l JOIN (
        SELECT subset, count(*) FILTER (WHERE RUL_capped >= 100) >= 50 AS by_rul FROM lab WHERE split = 'train'
        GROUP BY subset) c USING (subset)
    WHERE (by_rul AND RUL_capped >= 100) OR (NOT by_rul AND cycle <= 30)"""),
    "baseline": (("healthy", "usable"), """
    SELECT subset, sensor, avg(x) AS mean, greatest(coalesce(stddev_samp(x), 0e0), 1e-6) AS std,
      min(x) AS min, max(x) AS max, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.75) AS p75
    FROM healthy JOIN usable USING (subset, sensor) GROUP BY ALL"""),
    "lablong": (("lab",), _long("lab", SENSORS, "sensor", "x", f"{UNIT}, cycle")),
    "zrank": (("lablong", "baseline"), f"""
    SELECT {UNIT}, cycle, sensor, z, {rnd('z', 2)} AS z2, {rnd('abs(z)', 2)} AS abs2, rk FROM (
      SELECT *, row_number() OVER (PARTITION BY {UNIT}, cycle
          ORDER BY abs(z) DESC, CAST(substr(sensor, 8) AS INTEGER)) AS rk
      FROM (SELECT l.*, (x - mean) / std AS z FROM lablong l JOIN baseline USING (subset, sensor)))"""),
    "expl": (("zrank",), f"""
    SELECT {UNIT}, cycle,
      {', '.join(f"max(sensor) FILTER (WHERE rk = {k}) AS top_sensor_{k}, max(z2) FILTER (WHERE rk = {k}) AS top_sensor_{k}_zscore, max(abs2) FILTER (WHERE rk = {k}) AS top_sensor_{k}_abs_dev" for k in (1, 2, 3))},
      coalesce(string_agg(sensor || ' (' || CASE WHEN z2 >= 0 THEN '+' ELSE '' END || printf('%.2f', z2) || 'σ, ' ||
        {steps(C.DEVIATION_LEVELS, 'abs(z2)')} || ')', ' | ' ORDER BY rk)
        FILTER (WHERE rk <= 3 AND abs2 >= 1), {q(C.NOMINAL_TEXT)}) AS top_abnormal_sensors,
      max(abs2) FILTER (WHERE rk = 1) AS max_sensor_deviation,
      {rnd('least(100e0, 25e0 * max(abs(z)))', 2)} AS anomaly_score
    FROM zrank GROUP BY ALL"""),
    "scored": (("expl", "lab"), f"""
    SELECT e.*, CAST(RUL_capped AS DOUBLE) AS predicted_RUL, CAST(RUL AS DOUBLE) AS true_RUL, RUL_capped,
      CASE WHEN anomaly_score >= 60 THEN 'Anomalous' ELSE 'Normal' END AS anomaly_label,
      {steps(C.ANOMALY_SEVERITIES, 'anomaly_score')} AS anomaly_severity
    FROM expl e JOIN lab l USING ({UNIT}, cycle)"""),
    "lastscored": (("scored",), f"""
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY {UNIT} ORDER BY cycle DESC) = 1"""),
    "assessed": (("scored",), f"""
    SELECT *, {_STATUS} AS engine_health_status, {_RISK} AS risk_level,
      {composite('predicted_RUL', 'anomaly_score')} AS composite_health_score FROM scored"""),
    "fleet": (("lastscored",), f"""
    SELECT {UNIT}, cycle AS latest_observed_cycle, predicted_RUL, true_RUL,
      {rnd('abs(predicted_RUL - true_RUL)', 2)} AS absolute_error,
      {rnd('least(greatest(predicted_RUL / 125e0 * 100e0, 0e0), 100e0)', 2)} AS rul_health_score,
      anomaly_score AS latest_anomaly_score, anomaly_label AS latest_anomaly_status,
      anomaly_severity AS latest_anomaly_severity, top_abnormal_sensors, top_sensor_1 AS leading_sensor,
      {_STATUS} AS engine_health_status, {_RISK} AS risk_level,
      {composite('predicted_RUL', 'anomaly_score')} AS composite_health_score
    FROM lastscored WHERE split = 'test'"""),
    "lifepred": (("lab",), f"""
    SELECT {UNIT}, cycle, CAST(RUL AS DOUBLE) AS true_RUL, CAST(RUL_capped AS DOUBLE) AS true_RUL_capped,
      {rnd('least(greatest(mean_life - cycle, 0e0), 125e0)', 2)} AS predicted_RUL
    FROM lab JOIN (SELECT subset, avg(life) AS mean_life FROM (
        SELECT subset, engine_id, max(cycle) AS life FROM lab WHERE split = 'train' GROUP BY ALL) GROUP BY ALL)
      USING (subset)"""),
    "lastpred": (("lifepred",), f"""
    SELECT * FROM lifepred QUALIFY row_number() OVER (PARTITION BY {UNIT} ORDER BY cycle DESC) = 1"""),
    "protocol": ((), f"""
    SELECT * FROM (VALUES {values(C.PROTOCOLS)}) p(subsystem, protocol_code, protocol_title, labour_hours, aog_risk,
      window_days)"""),
    "sensordim": ((), f"""
    SELECT * FROM (VALUES {values([(s, int(s.split('_')[1]), n, c, y) for s, n, c, y in C.SENSOR_DIM])})
      d(sensor, position, name, component, system)"""),
    "dirty": (("tel",), f"""
    SELECT subset, split, {', '.join(f"CASE WHEN NOT empty THEN {c} END AS {c}" for c in
      ('engine_id', 'cycle') + SETTINGS + SENSORS)} FROM (
      SELECT * REPLACE (
          CASE WHEN setting_3 = 3 AND sensor_2 = 13 THEN CAST('inf' AS DOUBLE)
            WHEN setting_3 = 4 AND sensor_2 = 17 THEN CAST('-inf' AS DOUBLE) ELSE sensor_2 END AS sensor_2,
          CASE WHEN setting_3 = 2 AND sensor_2 = 7 THEN CAST('nan' AS DOUBLE) ELSE sensor_3 END AS sensor_3,
          CASE WHEN setting_3 = 1 AND sensor_2 = 29 THEN -1 ELSE engine_id END AS engine_id,
          CASE WHEN setting_3 = 1 AND sensor_2 = 31 THEN 0 ELSE cycle END AS cycle),
        setting_3 = 5 AND sensor_2 = 50 AS empty, setting_3 = 7 AS doubled
      FROM tel) t, range(2) r(i) WHERE i = 0 OR doubled"""),
    "mended": (("dirty",), f"""
    SELECT subset, split, engine_id, cycle, setting_1, setting_2, setting_3, {', '.join(
      f"CASE WHEN isfinite({s}) THEN {s} END AS {s}" for s in SENSORS)} FROM dirty"""),
}


def with_ctes(body: str, *names: str) -> str:
    """Prefixes ``body`` with the named expressions and everything they need, in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for need in CTES[name][0]:
            visit(need)
        ordered.append(name)

    for name in names:
        visit(name)
    # Each table is computed once, however often it is referred to.
    clauses = ",\n".join(f"{name} AS MATERIALIZED ({CTES[name][1]})" for name in ordered)
    own = body.lstrip()
    if own.startswith("WITH "):
        return f"WITH {clauses},\n{own[5:]}"
    return f"WITH {clauses}\n{body}"


def long(source: str, columns, name: str, value: str, keys: str) -> str:
    return _long(source, columns, name, value, keys)
