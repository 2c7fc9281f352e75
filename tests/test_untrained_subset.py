"""A subset found in the test split only keeps its rows, without scores or predictions."""

import pytest
from pyspark.sql import functions as F

from bladewatch.catalog import inputs
from bladewatch.constants import SENSORS
from bladewatch.functions import health
from bladewatch.operators import explain, iforest
from bladewatch.operators.stats import baseline_moments

SCORES = ["anomaly_score", "anomaly_label", "anomaly_severity"]


@pytest.fixture(scope="module")
def rows(spark):
    base = spark.range(400).select(
        F.when(F.col("id") < 300, F.lit("A")).otherwise(F.lit("B")).alias("subset"),
        F.when(F.col("id") < 200, F.lit("train")).otherwise(F.lit("test")).alias("split"),
        (F.col("id") / 50).cast("long").alias("engine_id"), (F.col("id") % 50 + 1).alias("cycle"),
        F.lit(5).cast("long").alias("RUL"), F.lit(5).cast("long").alias("RUL_capped"),
        *[(F.xxhash64("id", F.lit(s)) % 1000 / 100.0).alias(s) for s in SENSORS])
    return base.cache()


def seen(df, columns):
    """Per subset: rows and rows with each of the columns."""
    return {r[0]: tuple(r)[1:] for r in df.groupBy("subset").agg(F.count(F.lit(1)), *[F.count(c) for c in columns]).collect()}


def test_rule_scores(rows):
    got = seen(explain.rule_scores(rows, baseline_moments(inputs.train_rows(rows))), SCORES)
    assert got == {"A": (300, 300, 300, 300), "B": (100, 0, 0, 0)}


def test_forest_scores(rows):
    forest = iforest.fit_forest(inputs.train_rows(rows), list(SENSORS[:4]), trees=5)
    got = seen(forest.score(rows), ["anomaly_raw_score", "anomaly_vote", *SCORES])
    assert got == {"A": (300,) * 6, "B": (100, 0, 0, 0, 0, 0)}


def test_life_predictions(spark, rows, monkeypatch):
    monkeypatch.setattr(inputs, "labelled", lambda *a, **k: rows)
    assert seen(inputs.life_predictions(spark, "unused"), ["predicted_RUL"]) == {"A": (300, 300), "B": (100, 0)}


def test_nothing_unscored_is_healthy(spark):
    df = spark.createDataFrame([(100.0, 10.0), (100.0, None), (None, 10.0), (None, None), (10.0, None)], "r double, a double")
    got = [r[0] for r in df.select(health.health_status(F.col("r"), F.col("a"))["status"]).collect()]
    assert got == ["HEALTHY", None, None, None, "CRITICAL"]
