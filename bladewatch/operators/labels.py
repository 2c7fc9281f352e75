"""Remaining-useful-life labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bladewatch.constants import RUL_CAP, UNIT
from bladewatch.operators.ordering import bucketed_ordinal

ENGINE_BUCKET = 1 << 16


def _capped(rul: Column, cap: int | None) -> Column:
    return F.when(rul.isNotNull(), F.least(rul, F.lit(cap).cast("long"))) if cap else rul


def last_cycle(df: DataFrame, split_hot: bool = False) -> DataFrame:
    """Adds ``last_cycle`` of each engine.

    The window form shares the engine partitioning of the neighbouring steps. With ``split_hot`` the
    maximum is pre-aggregated and joined back, which leaves a huge engine spread over many tasks.
    """
    if not split_hot:
        return df.withColumn("last_cycle", F.max("cycle").over(Window.partitionBy(*UNIT)))
    ends = df.groupBy(*UNIT).agg(F.max("cycle").alias("last_cycle"))
    return df.join(ends, list(UNIT))


def add_train_rul(df: DataFrame, cap: int | None = RUL_CAP, split_hot: bool = False) -> DataFrame:
    """RUL counts down to the engine's last cycle."""
    rul = F.col("last_cycle") - F.col("cycle")
    out = last_cycle(df, split_hot).withColumn("RUL", rul.cast("long"))
    return out.withColumn("RUL_capped", _capped(F.col("RUL"), cap)).drop("last_cycle")


def engine_ordinals(df: DataFrame) -> DataFrame:
    """Position of each engine among the sorted engine ids of its (subset, split)."""
    ids = df.select(*UNIT).distinct()
    bucket = F.floor(F.col("engine_id") / F.lit(ENGINE_BUCKET))
    return bucketed_ordinal(ids, ["subset", "split"], bucket, [F.col("engine_id")], "engine_ordinal")


def true_rul_by_engine(test: DataFrame, truth: DataFrame) -> DataFrame:
    """Line i of the ground-truth vector belongs to the i-th engine id; NULL where the vector has no such line."""
    return (
        engine_ordinals(test)
        .join(truth.select("subset", "engine_ordinal", "true_rul"), ["subset", "engine_ordinal"], "left")
        .select(*UNIT, "engine_ordinal", "true_rul")
    )


def check_truth_counts(test: DataFrame, truth: DataFrame) -> None:
    """Error when a subset's ground-truth vector and its engine count differ."""
    engines = test.groupBy("subset").agg(F.count_distinct("engine_id").alias("engines"))
    lines = truth.groupBy("subset").agg(F.count(F.lit(1)).alias("lines"))
    bad = (
        engines.join(lines, "subset", "left")
        .filter(F.col("engines") != F.coalesce("lines", F.lit(0)))
        .orderBy("subset")
        .collect()
    )
    if bad:
        raise ValueError("engine count differs from ground-truth lines: " + ", ".join(
            f"{r['subset']} has {r['engines']} engines and {r['lines'] or 0} lines" for r in bad))


def add_test_rul(df: DataFrame, truth: DataFrame, cap: int | None = RUL_CAP, split_hot: bool = False) -> DataFrame:
    """RUL = known RUL at the last observed cycle plus the cycles up to it."""
    known = true_rul_by_engine(df, truth).select(*UNIT, "true_rul")
    rul = F.col("true_rul") + F.col("last_cycle") - F.col("cycle")
    out = last_cycle(df, split_hot).join(known, list(UNIT), "left").withColumn("RUL", rul.cast("long"))
    return out.withColumn("RUL_capped", _capped(F.col("RUL"), cap)).drop("last_cycle", "true_rul")


def add_rul(df: DataFrame, truth: DataFrame, cap: int | None = RUL_CAP, split_hot: bool = False) -> DataFrame:
    """Both splits in one pass: train engines run to failure, test engines end ``true_rul`` cycles early.

    A test engine without a line in the ground-truth vector keeps its rows, with a NULL label.
    """
    known = true_rul_by_engine(df.filter(F.col("split") == "test"), truth).select(*UNIT, "true_rul")
    left = F.when(F.col("split") == "train", F.lit(0)).otherwise(F.col("true_rul"))
    rul = left + F.col("last_cycle") - F.col("cycle")
    out = last_cycle(df, split_hot).join(known, list(UNIT), "left").withColumn("RUL", rul.cast("long"))
    return out.withColumn("RUL_capped", _capped(F.col("RUL"), cap)).drop("last_cycle", "true_rul")
