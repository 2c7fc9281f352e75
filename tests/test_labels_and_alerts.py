"""Labels without ground truth, checks that name what is missing, and first alerts by event time."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bladewatch.operators.labels import add_rul, check_truth_counts
from bladewatch.operators.plotdata import status_distribution
from bladewatch.streaming import telemetry as streams

UNITS = "subset string, split string, engine_id long, cycle long"


def test_missing_truth_keeps_rows(spark):
    rows = [("FD009", "test", e, c) for e in (1, 2) for c in (1, 2, 3)] + [("FD009", "train", 3, c) for c in (1, 2)]
    df = spark.createDataFrame(rows, UNITS)
    truth = spark.createDataFrame([("FD009", 1, 10)], "subset string, engine_ordinal long, true_rul long")
    got = {(r["engine_id"], r["cycle"]): (r["RUL"], r["RUL_capped"]) for r in add_rul(df, truth, cap=11).collect()}
    assert got == {(1, 1): (12, 11), (1, 2): (11, 11), (1, 3): (10, 10), (2, 1): (None, None), (2, 2): (None, None),
                   (2, 3): (None, None), (3, 1): (1, 1), (3, 2): (0, 0)}
    with pytest.raises(ValueError, match="FD009 has 2 engines and 1 lines"):
        check_truth_counts(df.filter("split = 'test'"), truth)


def test_shares_of_statuses_add_up(spark):
    fleet = spark.createDataFrame(
        [("A", "HEALTHY"), ("A", "SENSOR ANOMALY"), ("A", "CRITICAL"), ("A", "HEALTHY")], "subset string, engine_health_status string")
    got = {r["status"]: (r["engines"], r["pct"]) for r in status_distribution(fleet).collect()}
    assert got["OTHER"] == (1, 25.0) and sum(p for _, p in got.values()) == 100.0


def test_first_alert_is_the_earliest_of_all_batches(spark, tmp_path):
    """The second batch brings an earlier reading of engine 1 and later ones of both."""
    def day(d):
        return dt.datetime(2024, 1, d)

    batches = [[(1, day(5), 1, "e", 1.0, '{"k": 70}'), (2, day(6), 1, "e", 1.0, '{"k": 80}'), (3, day(1), 2, "e", 1.0, '{"k": 5}')],
               [(4, day(2), 1, "e", 1.0, '{"k": 61}'), (5, day(9), 2, "e", 1.0, '{"k": 99}')]]
    schema = streams.EVENT_SCHEMA
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}.parquet")
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    alerts = streams.run_to_table(streams.first_alerts(streams.as_readings(events)), f"{tmp_path}/out")
    got = {r["engine_id"]: (r["event_id"], r["day"]) for r in streams.settled_alerts(alerts).withColumn(
        "day", F.dayofmonth("at")).collect()}
    assert got == {2: (4, 2), 3: (5, 9)}
