"""Queries over sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from bladewatch import constants as C
from bladewatch.catalog import data_queries, decision_queries
from bladewatch.catalog.data_queries import rolled
from bladewatch.catalog.decision_queries import EVENT_REQUESTS, request_sql
from bladewatch.catalog.inputs import fleet, train_rows
from bladewatch.catalog.sql_base import SENSORS, SETTINGS, UNIT, rnd, with_ctes
from bladewatch.functions.numeric import half_even
from bladewatch.operators import regimes
from bladewatch.session import scratch_path, tune
from bladewatch.sources import stages, text
from bladewatch.sources.stages import materialise
from bladewatch.sources.supplied import ground_truth, hot_units, labelled, table, unlabelled
from bladewatch.streaming import ordered
from bladewatch.streaming import telemetry as streams

QUERIES, SQL = {}, {}


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


K = f"{UNIT}, cycle"


@register("s1_raw_telemetry_text", with_ctes("SELECT * FROM tel", "tel"))
def s1_raw_telemetry_text(spark, sf_dir):
    """The telemetry written as raw text records and read back."""
    path = scratch_path(spark, "raw")
    text.write_telemetry(unlabelled(spark, sf_dir), path)
    return text.read_telemetry(spark, path).select(*C.UNIT, "cycle", *SETTINGS, *SENSORS)


# Rule-made defects of written records, by line number and quantity: what they say and what is wrong with them.
_DEFECTS = (
    ("cut", 7.0, 50.0, "expected 26 columns, found 12"), ("long", 6.0, 50.0, "expected 26 columns, found 27"),
    ("word", 5.0, 50.0, "not a number"), ("half", 4.0, 50.0, "not a whole number"), ("blank", 3.0, 50.0, "blank"))


def _spoiled(spark, sf_dir):
    """The telemetry as text records below a new folder, some of them spoiled."""
    path = scratch_path(spark, "spoiled")
    text.write_telemetry(unlabelled(spark, sf_dir), f"{path}/whole")
    cells = F.split("value", " ")
    hit = {kind: (cells[4].cast("double") == line) & (cells[6].cast("double") == quantity)
           for kind, line, quantity, _ in _DEFECTS}
    value = (
        F.when(hit["cut"], F.array_join(F.slice(cells, 1, 12), " "))
        .when(hit["long"], F.concat("value", F.lit(" 1.0")))
        .when(hit["word"], F.regexp_replace("value", r"\S+$", "n/a"))
        .when(hit["half"], F.regexp_replace("value", r"^\S+", "1.5"))
        .when(hit["blank"], "  ").otherwise(F.col("value")))
    text.write_lines(spark.read.text(f"{path}/whole").select("name", value.alias("value")), f"{path}/spoiled")
    return f"{path}/spoiled"


_PROBLEM = " ".join(f"WHEN setting_3 = {line} AND sensor_2 = {quantity} THEN '{what}'" for _, line, quantity, what in _DEFECTS)


@register("s1_record_counts", with_ctes(f"""
SELECT subset, split, count(*) AS lines, count(*) FILTER (WHERE p = 'blank') AS blank, count(*) FILTER (WHERE p IS NULL) AS good,
  count(*) FILTER (WHERE p <> 'blank') AS bad FROM (SELECT *, CASE {_PROBLEM} END AS p FROM tel) GROUP BY ALL""", "tel"))
def s1_record_counts(spark, sf_dir):
    """Spoiled records: good, bad and blank lines per file name add up to the lines."""
    counts = text.record_counts(spark, _spoiled(spark, sf_dir))
    return counts.groupBy(
        F.regexp_extract("file", text.TELEMETRY_NAME, 2).alias("subset"),
        F.regexp_extract("file", text.TELEMETRY_NAME, 1).alias("split")).agg(
        *[F.sum(c).alias(c) for c in ("lines", "blank", "good", "bad")])


@register("s1_bad_records", with_ctes(f"""
SELECT p AS problem, count(*) AS records, true AS placed FROM (SELECT CASE {_PROBLEM} END AS p FROM tel)
WHERE p <> 'blank' GROUP BY ALL""", "tel"))
def s1_bad_records(spark, sf_dir):
    """Bad records by problem; ``placed``: each has a line number of its own within its file."""
    bad = text.bad_records(spark, _spoiled(spark, sf_dir))
    return bad.groupBy("problem").agg(
        F.count(F.lit(1)).alias("records"),
        ((F.count_distinct("file", "line_number") == F.count(F.lit(1))) & (F.min("line_number") > 0)).alias("placed"))


@register("s2_true_rul_text", with_ctes("SELECT * FROM truth", "truth"))
def s2_true_rul_text(spark, sf_dir):
    path = scratch_path(spark, "truth")
    text.write_truth(ground_truth(spark, sf_dir), path)
    return text.read_truth(spark, path)


@register("s3_model_inputs", with_ctes(
    f"SELECT subset, split, 'processed' AS stage, count(*) AS rows FROM lab GROUP BY ALL UNION ALL "
    f"SELECT subset, split, 'features', count(*) FROM lab GROUP BY ALL", "lab"))
def s3_model_inputs(spark, sf_dir):
    """Model inputs before and after the feature stage exists: processed rows first, features later."""
    root, dealt = scratch_path(spark, "stages"), not hot_units(spark, sf_dir)
    stages.save_stage(labelled(spark, sf_dir), root, "processed", dealt)
    before = stages.load_model_inputs(spark, root)
    had = "features" if "sensor_2_diff" in before.columns else "processed"
    first = before.groupBy(*C.FRAME).agg(F.count(F.lit(1)).alias("rows")).withColumn("stage", F.lit(had))
    stages.save_stage(rolled(spark, sf_dir), root, "features", dealt)
    after = stages.load_model_inputs(spark, root)
    has = "features" if "sensor_2_diff" in after.columns else "processed"
    second = after.groupBy(*C.FRAME).agg(F.count(F.lit(1)).alias("rows")).withColumn("stage", F.lit(has))
    return first.unionByName(second)


@register("s4_stage_table", with_ctes("SELECT * FROM lab", "lab"))
def s4_stage_table(spark, sf_dir):
    root = scratch_path(spark, "stages")
    stages.save_stage(labelled(spark, sf_dir), root, "cleaned")
    return stages.load_stage(spark, root, "cleaned")


_EXPORT = ("engine_id", "latest_observed_cycle", "predicted_RUL", "latest_anomaly_score", "engine_health_status",
           "risk_level", "composite_health_score")


@register("s5_advisory_export", with_ctes(
    f"SELECT 'json' AS format, {', '.join(_EXPORT)} FROM fleet UNION ALL SELECT 'csv', {', '.join(_EXPORT)} FROM fleet",
    "fleet"))
def s5_advisory_export(spark, sf_dir):
    """Fleet advisory written as JSON records and CSV, and both read back."""
    path = scratch_path(spark, "export")
    rows = stages.materialise(fleet(spark, sf_dir).select(*_EXPORT), "fleet")
    stages.export_json(rows, f"{path}/json")
    stages.export_csv(rows, f"{path}/csv")
    back = spark.read.schema(rows.schema).json(f"{path}/json").withColumn("format", F.lit("json"))
    other = spark.read.schema(rows.schema).option("header", True).csv(f"{path}/csv").withColumn("format", F.lit("csv"))
    return back.unionByName(other)


def _documents(spark, name, rows):
    path = scratch_path(spark, "documents")
    stages.export_documents(rows, path, name)
    return stages.load_documents(spark, path, name, rows.schema).select(*rows.columns)


@register("s5_dataset_documents", data_queries.SQL["a5_dataset_report"])
def s5_dataset_documents(spark, sf_dir):
    """The dataset report as one JSON document per subset, written and read back."""
    return _documents(spark, "dataset_report", data_queries.QUERIES["a5_dataset_report"](spark, sf_dir))


@register("s5_executive_documents", decision_queries.SQL["a14_executive_report"])
def s5_executive_documents(spark, sf_dir):
    """The executive report as one JSON document per subset, written and read back."""
    return _documents(spark, "fleet_report", decision_queries.QUERIES["a14_executive_report"](spark, sf_dir))


@register("s6_report_download", with_ctes(
    f"SELECT 'fleet' AS report_type, (SELECT count(*) FROM fleet) AS total_records, {', '.join(_EXPORT)} FROM fleet",
    "fleet"))
def s6_report_download(spark, sf_dir):
    records = stages.report_records(fleet(spark, sf_dir).select(*_EXPORT))
    return records.select("report_type", "total_records", "data.*")


@register("s7_saved_normaliser", with_ctes(
    " UNION ALL ".join(
        f"SELECT subset, '{s}' AS sensor, {rnd(f'avg({s})', 4)} AS mean, {rnd(f'stddev_samp({s})', 4)} AS std "
        f"FROM lab WHERE split = 'train' GROUP BY ALL HAVING var_samp({s}) > 1e-5" for s in SENSORS), "lab"))
def s7_saved_normaliser(spark, sf_dir):
    """Normaliser statistics saved as a table and loaded again (one regime per subset)."""
    path = scratch_path(spark, "normaliser")
    train = train_rows(labelled(spark, sf_dir)).withColumn("_regime", F.lit(0))
    regimes.regime_statistics(train).write.parquet(path)
    wide = spark.read.parquet(path)
    entries = [F.struct(F.lit(s).alias("sensor"), half_even(F.col(f"mean_{s}"), 4).alias("mean"),
                        half_even(F.col(f"std_{s}"), 4).alias("std")) for s in SENSORS]
    return wide.select("subset", F.inline(F.array(*entries))).filter("mean is not null")


# --- streams ------------------------------------------------------------------------------------
def _stream(spark, sf_dir):
    return streams.read_events(tune(spark), sf_dir)


@register("t1_stream_scoring", request_sql(EVENT_REQUESTS))
def t1_stream_scoring(spark, sf_dir):
    return streams.run_to_table(streams.score_stream(_stream(spark, sf_dir)), scratch_path(spark, "scores"))


_P = "OVER (PARTITION BY user_id ORDER BY ts, event_id"


@register("t2_stream_rolling_features", f"""
SELECT user_id + 1 AS engine_id, event_id, {rnd(f'avg(value) {_P} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)', 4)}
    AS rolling_mean,
  {rnd(f'coalesce(stddev_samp(value) {_P} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0e0)', 4)} AS rolling_std,
  {rnd(f'coalesce(value - lag(value) {_P}), 0e0)', 4)} AS diff,
  {rnd(f'CASE WHEN abs(lag(value) {_P})) > 1e-9 THEN (value - lag(value) {_P})) / abs(lag(value) {_P})) * 100e0 ELSE 0e0 END', 4)}
    AS pct_change, CAST(0 AS BIGINT) AS late_rows FROM events""")
def t2_stream_rolling_features(spark, sf_dir):
    out = streams.run_to_table(streams.rolling_stream(_stream(spark, sf_dir)), scratch_path(spark, "rolling"))
    numbers = {c: half_even(F.col(c), 4) for c in ("rolling_mean", "rolling_std", "diff", "pct_change")}
    return out.withColumns(numbers).drop("at")


SLICES = 4


def _sliced_events(spark, sf_dir, delay_seconds):
    """The events in files of arrival, one for each of SLICES equal times: each event comes up to ``delay_seconds`` late."""
    events = table(spark, sf_dir, "events")
    path = scratch_path(spark, "arrivals")
    late = F.pmod(F.xxhash64("event_id"), F.lit(delay_seconds))
    placed = materialise(events.withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6) + late), "arrivals")
    first, last = placed.agg(F.min("_at"), F.max("_at")).first()
    cell = F.least(F.floor((F.col("_at") - first) / ((last - first) / SLICES)), F.lit(SLICES - 1))
    for k in range(SLICES):  # one write after the other, so that the files are taken in this order
        placed.filter(cell == k).drop("_at").coalesce(1).write.mode("append").parquet(path)
    return path


@register("t2_rolling_in_order", f"""
SELECT engine_id, event_id, rolling_mean, rolling_std, diff, pct_change FROM (
SELECT user_id + 1 AS engine_id, event_id, ts, {rnd(f'avg(value) {_P} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)', 4)}
    AS rolling_mean,
  {rnd(f'coalesce(stddev_samp(value) {_P} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0e0)', 4)} AS rolling_std,
  {rnd(f'coalesce(value - lag(value) {_P}), 0e0)', 4)} AS diff,
  {rnd(f'CASE WHEN abs(lag(value) {_P})) > 1e-9 THEN (value - lag(value) {_P})) / abs(lag(value) {_P})) * 100e0 ELSE 0e0 END', 4)}
    AS pct_change FROM events)
WHERE date_trunc('minute', ts) + INTERVAL 1 MINUTE <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)""")
def t2_rolling_in_order(spark, sf_dir):
    """Events that come in several batches and out of order, taken in order of time; the last ten minutes wait."""
    stream = streams.read_events(tune(spark), _sliced_events(spark, sf_dir, 590), "*.parquet", files_per_batch=1)
    out = streams.run_to_table(ordered.ordered_rolling_stream(stream), scratch_path(spark, "ordered"))
    numbers = {c: half_even(F.col(c), 4) for c in ("rolling_mean", "rolling_std", "diff", "pct_change")}
    return out.withColumns(numbers).drop("at")


@register("t3_stream_anomaly_rate", f"""
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS readings, count(*) FILTER (WHERE k >= 60) AS anomalies,
  {rnd('count(*) FILTER (WHERE k >= 60) / CAST(count(*) AS DOUBLE) * 100e0', 4)} AS anomaly_pct
FROM (SELECT date_trunc('hour', ts) AS w, ts, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
GROUP BY w HAVING w + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)""")
def t3_stream_anomaly_rate(spark, sf_dir):
    out = streams.run_to_table(streams.anomaly_rate(_stream(spark, sf_dir)), scratch_path(spark, "rates"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "readings",
                      "anomalies", half_even(F.col("anomaly_pct"), 4).alias("anomaly_pct"))


@register("t3_first_alerts", """
SELECT user_id + 1 AS engine_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, event_id,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS anomaly_score FROM events
WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 60
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""")
def t3_first_alerts(spark, sf_dir):
    out = streams.run_to_table(streams.first_alerts(_stream(spark, sf_dir)), scratch_path(spark, "alerts"))
    return streams.settled_alerts(out).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))
