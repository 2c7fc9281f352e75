"""Frames the registered queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bladewatch.constants import RUL_CAP
from bladewatch.functions.numeric import clip, half_even
from bladewatch.operators.advisory import fleet_advisory
from bladewatch.operators.explain import rule_scores
from bladewatch.operators.features import engine_tail
from bladewatch.operators.lookup import find_engine
from bladewatch.operators.stats import baseline_moments, lifetimes
from bladewatch.sources.supplied import labelled


def train_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("split") == "train")


def test_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("split") == "test")


def scored(spark: SparkSession, sf_dir: str, engine_id: int | None = None) -> DataFrame:
    """Labelled cycles, of one engine or all, with rule-based anomaly scores; predicted_RUL is the capped label."""
    lab = labelled(spark, sf_dir)
    return _scored_rows(lab, lab if engine_id is None else find_engine(lab, engine_id))


def _scored_rows(lab: DataFrame, rows: DataFrame) -> DataFrame:
    out = rule_scores(rows, baseline_moments(train_rows(lab)))
    return out.withColumns({
        "predicted_RUL": F.col("RUL_capped").cast("double"), "true_RUL": F.col("RUL").cast("double")})


def fleet(spark: SparkSession, sf_dir: str, engine_id: int | None = None) -> DataFrame:
    """The advisory of each test engine; a score needs its own row only, so last rows are taken before they are scored."""
    lab = labelled(spark, sf_dir)
    rows = engine_tail(test_rows(lab if engine_id is None else find_engine(lab, engine_id)))
    return fleet_advisory(_scored_rows(lab, rows))


def life_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple predictor: mean training lifetime of the subset minus the cycle, within 0..cap; NULL without training rows."""
    lab = labelled(spark, sf_dir, sensors=())
    mean_life = lifetimes(train_rows(lab)).groupBy("subset").agg(F.avg("lifetime").alias("mean_life"))
    predicted = F.when(F.col("mean_life").isNotNull(), half_even(
        clip(F.col("mean_life") - F.col("cycle"), 0.0, float(RUL_CAP)), 2))
    return lab.join(F.broadcast(mean_life), "subset", "left").select(
        "subset", "split", "engine_id", "cycle", F.col("RUL").cast("double").alias("true_RUL"),
        F.col("RUL_capped").cast("double").alias("true_RUL_capped"), predicted.alias("predicted_RUL"))


def last_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_tail(life_predictions(spark, sf_dir))
