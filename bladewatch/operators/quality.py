"""Cleaning, quality reports and output checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType

from bladewatch import constants as C
from bladewatch.functions.numeric import finite, half_even
from bladewatch.operators.features import present


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]


def inf_to_missing(df: DataFrame) -> DataFrame:
    """NaN and both infinities become NULL in every floating column."""
    return df.withColumns({c: finite(F.col(c)) for c in float_columns(df)})


def inf_counts(df: DataFrame) -> DataFrame:
    infinite = [F.count_if(F.col(c).isin(float("inf"), float("-inf"))) for c in float_columns(df)]
    total = infinite[0]
    for item in infinite[1:]:
        total = total + item
    return df.groupBy(*C.FRAME).agg(total.alias("infinite_values_found"))


def missing_counts(df: DataFrame, columns=None) -> DataFrame:
    """Missing values per column, long form, after infinities became missing."""
    columns = columns or [c for c in df.columns if c not in C.FRAME]
    wide = inf_to_missing(df).groupBy(*C.FRAME).agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    return wide.unpivot([*C.FRAME, "rows"], columns, "column_name", "missing")


def drop_all_missing(df: DataFrame) -> DataFrame:
    """Drops rows whose measured columns are all missing; the partition columns do not count."""
    return df.na.drop("all", subset=[c for c in df.columns if c not in C.FRAME])


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """One copy of each full row; copies are merged before the exchange."""
    return df.dropDuplicates()


def clean(df: DataFrame) -> DataFrame:
    """Infinities to missing, then fully missing rows out, then exact copies out."""
    return drop_duplicate_rows(drop_all_missing(inf_to_missing(df)))


def invalid_keys(df: DataFrame) -> DataFrame:
    return df.groupBy(*C.FRAME).agg(
        F.count_if(F.col("cycle") <= 0).alias("invalid_cycle_values"),
        F.count_if(F.col("engine_id") <= 0).alias("invalid_engine_id_values"),
    )


def duplicate_counts(df: DataFrame) -> DataFrame:
    """Rows beyond the first copy. Equal rows are counted on the map side first."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    return copies.groupBy(*C.FRAME).agg(
        F.sum("_copies").alias("rows"), F.sum(F.col("_copies") - 1).alias("duplicate_rows")
    )


def quality_report(df: DataFrame) -> DataFrame:
    """One row per (subset, split): shapes, defects, sensor classes, variances and variation coefficients."""
    sensors = present(df, C.SENSORS)
    measured = [c for c in df.columns if c not in C.FRAME]
    width = len(measured)
    infinite = F.lit(0)
    for c in float_columns(df):
        infinite = infinite + F.when(F.col(c).isin(float("inf"), float("-inf")), 1).otherwise(0)
    marked = df.withColumn("_inf", infinite)
    prepared = inf_to_missing(marked)
    gaps = F.lit(0)
    for c in measured:
        gaps = gaps + F.when(F.col(c).isNull(), 1).otherwise(0)
    # Copies of a row are merged once; every later figure is weighted by the copy count or taken on the kept row.
    merged = (
        prepared.withColumn("_gaps", gaps)
        .groupBy(*df.columns)
        .agg(F.count(F.lit(1)).alias("_copies"), F.sum("_inf").alias("_inf"), F.first("_gaps").alias("_gaps"))
    )
    kept = F.col("_gaps") < width

    def of(c: str):
        return F.when(kept, F.col(c))

    wide = merged.groupBy(*C.FRAME).agg(
        F.sum("_copies").alias("original_rows"),
        F.sum("_inf").alias("infinite_values_found"),
        F.sum(F.col("_gaps") * F.col("_copies")).alias("total_missing_values"),
        F.sum(F.when(~kept, F.col("_copies")).otherwise(0)).alias("fully_missing_rows_dropped"),
        F.sum(F.when(kept, F.col("_copies") - 1).otherwise(0)).alias("duplicate_rows_removed"),
        F.count_if(kept & (F.col("cycle") <= 0)).alias("invalid_cycle_values"),
        F.count_if(kept & (F.col("engine_id") <= 0)).alias("invalid_engine_id_values"),
        F.count_if(kept).alias("cleaned_rows"),
        *[F.var_samp(of(s)).alias(f"v_{s}") for s in sensors],
        *[
            F.coalesce(F.try_divide(F.stddev_samp(of(s)), F.abs(F.nullif(F.avg(of(s)), F.lit(0.0)))), F.lit(0.0))
            .alias(f"c_{s}")
            for s in sensors
        ],
    )
    names = F.array(*[F.lit(s) for s in sensors])
    variances = F.map_from_arrays(names, F.array(*[F.col(f"v_{s}") for s in sensors]))
    variation = F.map_from_arrays(names, F.array(*[F.col(f"c_{s}") for s in sensors]))

    def listed(low, high):
        keep = [
            F.when((F.col(f"v_{s}") > low) & (F.col(f"v_{s}") <= high), F.lit(s)) for s in sensors
        ]
        return F.array_join(F.array_compact(F.array(*keep)), ",")

    return wide.select(
        *C.FRAME, "original_rows", F.lit(width).alias("columns"), "infinite_values_found", "total_missing_values",
        "fully_missing_rows_dropped", "duplicate_rows_removed", "invalid_cycle_values", "invalid_engine_id_values",
        listed(-1.0, C.CONSTANT_VARIANCE).alias("constant_sensors"),
        listed(C.CONSTANT_VARIANCE, C.NEAR_CONSTANT_VARIANCE).alias("near_constant_sensors"),
        variances.alias("sensor_variances"), variation.alias("sensor_coefficient_of_variation"), "cleaned_rows",
    )


def selected_features(df: DataFrame, threshold: float = C.CONSTANT_VARIANCE) -> DataFrame:
    """Numeric model columns with their variance and whether they vary enough to be used."""
    ignored = {"engine_id", "cycle", "RUL", "RUL_capped", "anomaly_score", "anomaly_label"}
    numeric = [n for n, t in df.dtypes if t in ("double", "float", "int", "bigint") and n not in ignored]
    wide = df.groupBy(*C.FRAME).agg(*[F.var_samp(c).alias(c) for c in numeric])
    long = wide.unpivot(list(C.FRAME), numeric, "feature", "variance")
    return long.withColumn("selected", F.coalesce(F.col("variance") > threshold, F.lit(False)))


def model_columns(df: DataFrame) -> list[str]:
    """Columns a RUL model trains on: everything but keys and targets."""
    return [c for c in df.columns if c not in {*C.UNIT, "cycle", "RUL", "RUL_capped"}]


def require_columns(df: DataFrame, names) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing feature columns: {missing}")


def model_frame(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Keys, features in training order, and the target (capped RUL when there is one)."""
    features = features or model_columns(df)
    require_columns(df, features)
    target = [F.col("RUL_capped" if "RUL_capped" in df.columns else "RUL").alias("target")] if (
        {"RUL", "RUL_capped"} & set(df.columns)) else []
    return df.select(*C.UNIT, "cycle", *features, *target)


def output_checks(df: DataFrame, other_columns=None) -> DataFrame:
    """Rows (subset, split, check, violations, passed)."""
    measured = [c for c in df.columns if c not in C.FRAME]
    nulls, infinite = F.lit(0), F.lit(0)
    for c in measured:
        nulls = nulls + F.when(F.col(c).isNull(), 1).otherwise(0)
    for c in float_columns(df):
        infinite = infinite + F.when(F.col(c).isin(float("inf"), float("-inf")), 1).otherwise(0)
    mismatch = len(set(df.columns) ^ set(other_columns)) if other_columns is not None else 0
    absent = len({"engine_id", "cycle"} - set(df.columns))
    wide = df.groupBy(*C.FRAME).agg(
        F.sum(nulls).alias("no_missing"),
        F.sum(infinite).alias("no_infinite"),
        (F.count_if(F.col("RUL") < 0) if "RUL" in df.columns else F.lit(0).cast("long")).alias("rul_not_negative"),
        F.lit(absent).cast("long").alias("ids_present"),
        F.lit(mismatch).cast("long").alias("same_columns"),
    )
    names = ["no_missing", "no_infinite", "rul_not_negative", "ids_present", "same_columns"]
    return wide.unpivot(list(C.FRAME), names, "check", "violations").withColumn("passed", F.col("violations") == 0)


def frame_checks(train: DataFrame, test: DataFrame) -> DataFrame:
    """``output_checks`` of both frames, each compared with the other's columns."""
    return output_checks(train, test.columns).unionByName(output_checks(test, train.columns))


def assert_labels(df: DataFrame) -> DataFrame:
    """Fails the job on the first negative label, else passes the rows through."""
    message = F.concat(F.lit("negative RUL for engine "), F.col("engine_id").cast("string"))
    return df.filter(F.coalesce(F.assert_true(F.col("RUL") >= 0, message).cast("string"), F.lit("")) == "")


def rounded(df: DataFrame, digits: int) -> DataFrame:
    return df.withColumns({c: half_even(F.col(c), digits) for c in float_columns(df)})
