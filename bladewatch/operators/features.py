"""Per-engine rolling features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, TimestampType

from bladewatch.constants import PCT_CHANGE_FLOOR, ROLLING_WINDOW, SENSORS, SETTINGS, UNIT
from bladewatch.operators.ordering import has_oversized_unit
from bladewatch.session import unit_row_limit

FIXED = (BooleanType, DateType, NumericType, TimestampType)  # of a size that a hash table updates in place
KINDS = ("rolling_mean", "rolling_std", "diff", "pct_change")


def present(df: DataFrame, names) -> list[str]:
    return [c for c in names if c in df.columns]


def feature_names(sensors, settings) -> list[str]:
    return [f"{s}_{k}" for s in sensors for k in KINDS] + [f"{s}_rolling_mean" for s in settings]


def engineer_features(
    df: DataFrame,
    window: int = ROLLING_WINDOW,
    sensors: list[str] | None = None,
    settings: list[str] | None = None,
    split_hot: bool | None = None,
    block_cycles: int | None = None,
) -> DataFrame:
    """Rolling mean and std, lag-1 difference and percent change per sensor; rolling mean per setting.

    All columns come from one window spec, hence one exchange and one sort by engine. Engines with more
    rows than a task should sort are cut into blocks of cycles (``split_hot``; measured when not given),
    and every block gets the rows that precede it, so the values stay exact.
    """
    sensors = present(df, SENSORS) if sensors is None else sensors
    settings = present(df, SETTINGS) if settings is None else settings
    if split_hot is None:
        split_hot = has_oversized_unit(df)
    if not split_hot:
        return _over(df, list(UNIT), window, sensors, settings)
    block_cycles = block_cycles or unit_row_limit(df.sparkSession)
    blocks = df.withColumn("_block", F.floor(F.col("cycle") / F.lit(block_cycles)))
    return _over_blocks(blocks, window, sensors, settings)


def _over(df: DataFrame, keys: list[str], window: int, sensors, settings) -> DataFrame:
    ordered = Window.partitionBy(*keys).orderBy("cycle")
    rolling = ordered.rowsBetween(-(window - 1), 0)
    out = {}
    for s in sensors:
        prev = F.lag(s).over(ordered)
        diff = F.coalesce(F.col(s) - prev, F.lit(0.0))
        out[f"{s}_rolling_mean"] = F.avg(s).over(rolling)
        out[f"{s}_rolling_std"] = F.coalesce(F.stddev_samp(s).over(rolling), F.lit(0.0))
        out[f"{s}_diff"] = diff
        out[f"{s}_pct_change"] = F.when(
            F.abs(prev) > PCT_CHANGE_FLOOR, diff / F.abs(prev) * F.lit(100.0)
        ).otherwise(F.lit(0.0))
    for s in settings:
        out[f"{s}_rolling_mean"] = F.avg(s).over(rolling)
    return df.withColumns(out)


def _over_blocks(df: DataFrame, window: int, sensors, settings) -> DataFrame:
    keys = [*UNIT, "_block"]
    carried = window - 1
    newest = Window.partitionBy(*keys).orderBy(F.col("cycle").desc())
    row = F.struct("cycle", *sensors, *settings)
    tails = (
        df.withColumn("_back", F.row_number().over(newest))
        .filter(F.col("_back") <= carried)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(row)).alias("_tail"))
    )
    # A non-empty block has at least one row, so `carried` earlier blocks always hold enough of them.
    before = Window.partitionBy(*UNIT).orderBy("_block").rowsBetween(-carried, -1)
    history = (
        tails.withColumn("_past", F.flatten(F.collect_list("_tail").over(before)))
        .withColumn("_past", F.slice("_past", F.greatest(F.size("_past") - carried + 1, F.lit(1)), carried))
        .select(*keys, F.inline("_past"))
    )
    fed = df.withColumn("_given", F.lit(True)).unionByName(
        history.withColumn("_given", F.lit(False)), allowMissingColumns=True
    )
    return _over(fed, keys, window, sensors, settings).filter("_given").drop("_given", "_block")


def engine_tail(df: DataFrame) -> DataFrame:
    """Last observed row of each engine: one aggregate, pre-combined by each task, so few rows are shuffled.

    Columns of a fixed size are kept one by one, in a hash table. A whole row is no fixed-size value; for it Spark sorts
    each task's rows by engine.
    """
    rest = [c for c in df.columns if c not in UNIT and c != "cycle"]
    if all(isinstance(df.schema[c].dataType, FIXED) for c in rest):
        return df.groupBy(*UNIT).agg(
            F.max("cycle").alias("cycle"), *[F.max_by(c, "cycle").alias(c) for c in rest]).select(*df.columns)
    latest = F.max_by(F.struct("cycle", *rest), F.col("cycle")).alias("_last")
    return df.groupBy(*UNIT).agg(latest).select(*UNIT, "_last.*").select(*df.columns)


def first_cycles(df: DataFrame, k: int) -> DataFrame:
    """First k rows of each engine; the rank limit is applied before the exchange as well."""
    order = Window.partitionBy(*UNIT).orderBy("cycle")
    return df.withColumn("_position", F.row_number().over(order)).filter(F.col("_position") <= k).drop("_position")
