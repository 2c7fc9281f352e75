"""Streaming forms: stateless scoring, per-engine rolling features, anomaly rates and first alerts."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bladewatch.constants import ANOMALY_THRESHOLD, PCT_CHANGE_FLOOR, ROLLING_WINDOW
from bladewatch.operators.advisory import assess_request

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, name_filter: str = "events.parquet",
                files_per_batch: int | None = None) -> DataFrame:
    """Event stream over a folder of parquet files; batches are bounded by ``files_per_batch``."""
    reader = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", name_filter)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return as_readings(reader.parquet(path))


def as_readings(events: DataFrame) -> DataFrame:
    """Events as telemetry: unit, event time, reading, and a 0..99 anomaly score from the properties."""
    return events.select(
        "event_id", (F.col("user_id") + 1).alias("engine_id"), F.col("ts").cast("timestamp").alias("at"),
        F.col("value").alias("reading"),
        F.get_json_object("props", "$.k").cast("double").alias("anomaly_score"))


def run_to_table(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a streaming frame over what is available and returns the written table."""
    query = (
        df.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/table")
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/table")


def score_stream(readings: DataFrame) -> DataFrame:
    """Decision columns per reading; stateless, the same expressions as in batch."""
    label = F.when(F.col("anomaly_score") >= ANOMALY_THRESHOLD, "Anomalous").otherwise("Normal")
    requests = readings.select(
        "event_id", "engine_id", F.least(F.col("reading"), F.lit(125.0)).alias("predicted_RUL"), "anomaly_score",
        label.alias("anomaly_label"), F.lit("").alias("top_abnormal_sensors"))
    return assess_request(requests)


ROLLING_SCHEMA = ("engine_id bigint, event_id bigint, at timestamp, rolling_mean double, rolling_std double, "
                  "diff double, pct_change double, late_rows bigint")
STATE_SCHEMA = "last_at bigint, last_id bigint, values array<double>, late bigint"


def rolling_stream(readings: DataFrame, window: int = ROLLING_WINDOW) -> DataFrame:
    """Rolling mean and std, difference and percent change per engine over the stream.

    State per engine: the last ``window`` readings, the newest time seen and the count of late rows. Rows older
    than the newest time of an earlier batch are dropped and counted; within a batch rows are put in time order.
    A batch's size, set at the source, bounds the rows one engine can bring at once.
    """

    def update(key, batches: Iterable[pd.DataFrame], state: GroupState):
        last_at, last_id, kept, late = state.get if state.exists else (-(2**62), -1, [], 0)
        kept = list(kept)
        rows = pd.concat(list(batches), ignore_index=True)
        rows["us"] = rows["at"].astype("datetime64[us]").astype("int64")
        rows = rows.sort_values(["us", "event_id"], kind="stable")
        fresh = (rows["us"] > last_at) | ((rows["us"] == last_at) & (rows["event_id"] > last_id))
        late += int((~fresh).sum())
        rows = rows[fresh]
        if len(rows):
            series = np.array(kept + rows["reading"].tolist(), dtype=float)
            mean, std = _moments(series, window)
            diff = np.diff(series, prepend=series[0])
            prev = np.concatenate([[np.nan], series[:-1]])
            with np.errstate(invalid="ignore", divide="ignore"):
                pct = np.where(np.abs(prev) > PCT_CHANGE_FLOOR, diff / np.abs(prev) * 100.0, 0.0)
            new = slice(len(kept), None)
            yield pd.DataFrame({
                "engine_id": np.int64(key[0]), "event_id": rows["event_id"].to_numpy(), "at": rows["at"].to_numpy(),
                "rolling_mean": mean[new], "rolling_std": std[new], "diff": np.nan_to_num(diff[new]),
                "pct_change": np.nan_to_num(pct[new]), "late_rows": np.int64(late)})
            last_at, last_id = int(rows["us"].iloc[-1]), int(rows["event_id"].iloc[-1])
            kept = [float(v) for v in series[-window:]]
        state.update((last_at, last_id, kept, late))

    return readings.groupBy("engine_id").applyInPandasWithState(
        update, ROLLING_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def _moments(series: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    padded = np.concatenate([np.full(window - 1, np.nan), series])
    views = np.lib.stride_tricks.sliding_window_view(padded, window)
    mean = np.nanmean(views, axis=1)
    count = np.sum(~np.isnan(views), axis=1)
    squares = np.nansum((views - mean[:, None]) ** 2, axis=1)
    std = np.where(count > 1, np.sqrt(squares / np.maximum(count - 1, 1)), 0.0)
    return mean, std


def anomaly_rate(readings: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Tumbling-window counts of readings and anomalies per window, closed by the watermark."""
    hit = F.col("anomaly_score") >= ANOMALY_THRESHOLD
    return (
        readings.withWatermark("at", delay).groupBy(F.window("at", width))
        .agg(F.count(F.lit(1)).alias("readings"), F.count_if(hit).alias("anomalies"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "readings",
                "anomalies", (F.col("anomalies") / F.col("readings") * 100.0).alias("anomaly_pct"))
    )


ALERT_SCHEMA = "engine_id bigint, at timestamp, event_id bigint, anomaly_score double"


def first_alerts(readings: DataFrame) -> DataFrame:
    """The earliest anomalous reading of each engine in event time.

    State per engine: time and id of the earliest one so far. A late reading that is earlier gives a further row,
    which replaces the alert of that engine: a table of them holds the first alerts once reduced by
    ``settled_alerts``. Batches are looked at one after the other, never all at once.
    """
    hits = readings.filter(F.col("anomaly_score") >= ANOMALY_THRESHOLD)

    def update(key, batches: Iterable[pd.DataFrame], state: GroupState):
        known = state.get if state.exists else None
        best = None
        for rows in batches:
            first = rows.sort_values(["at", "event_id"], kind="stable").iloc[0]
            place = (int(np.datetime64(first["at"], "us").astype("int64")), int(first["event_id"]))
            if known is None or place < tuple(known):
                known, best = place, first
        if best is not None:
            state.update(known)
            yield pd.DataFrame({"engine_id": [np.int64(key[0])], "at": [best["at"]], "event_id": [best["event_id"]],
                                "anomaly_score": [best["anomaly_score"]]})

    return hits.groupBy("engine_id").applyInPandasWithState(
        update, ALERT_SCHEMA, "at bigint, event_id bigint", "append", GroupStateTimeout.NoTimeout)


def settled_alerts(alerts: DataFrame) -> DataFrame:
    """One row per engine: its earliest alert."""
    first = F.min(F.struct("at", "event_id", "anomaly_score")).alias("first")
    return alerts.groupBy("engine_id").agg(first).select("engine_id", "first.*")
