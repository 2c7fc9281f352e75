"""Sensor statistics, lifetimes, healthy baselines and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from bladewatch import constants as C
from bladewatch.functions.numeric import correlation
from bladewatch.operators.features import first_cycles, present
from bladewatch.operators.ranks import exact_percentiles


def sensor_class(variance):
    return (
        F.when(variance <= C.CONSTANT_VARIANCE, F.lit("constant"))
        .when(variance <= C.NEAR_CONSTANT_VARIANCE, F.lit("near_constant"))
        .otherwise(F.lit("variable"))
    )


def sensor_variances(df: DataFrame) -> DataFrame:
    sensors = present(df, C.SENSORS)
    wide = df.groupBy(*C.FRAME).agg(*[F.var_samp(s).alias(s) for s in sensors])
    return wide.unpivot(list(C.FRAME), sensors, "sensor", "variance").withColumn(
        "category", sensor_class(F.col("variance")))


def variation_coefficients(df: DataFrame) -> DataFrame:
    sensors = present(df, C.SENSORS)
    wide = df.groupBy(*C.FRAME).agg(*[
        F.coalesce(F.try_divide(F.stddev_samp(s), F.abs(F.nullif(F.avg(s), F.lit(0.0)))), F.lit(0.0)).alias(s)
        for s in sensors
    ])
    return wide.unpivot(list(C.FRAME), sensors, "sensor", "cv")


def sensor_statistics(df: DataFrame, with_distinct: bool = True) -> DataFrame:
    """One row per (subset, split, sensor); all moments come from one wide aggregate."""
    sensors = present(df, C.SENSORS)
    aggregates = []
    for s in sensors:
        x = F.col(s)
        aggregates.append(F.struct(
            F.lit(s).alias("sensor"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"), F.max(x).alias("max"), F.var_samp(x).alias("variance"),
            correlation(x, F.col("cycle")).alias("corr_with_cycle"),
            (F.lit(100.0) * F.count_if(x.isNull()) / F.count(F.lit(1))).alias("missing_pct"),
        ).alias(s))
    stats = df.groupBy(*C.FRAME).agg(*aggregates).select(*C.FRAME, F.inline(F.array(*sensors)))
    if with_distinct:
        # Values are de-duplicated on (frame, sensor, value) first, so the exact count has no large group.
        # Few values per sensor make the map-side step small; many spread over the value hash.
        long = df.unpivot(list(C.FRAME), sensors, "sensor", "value").filter("value is not null")
        distinct = long.distinct().groupBy(*C.FRAME, "sensor").agg(F.count(F.lit(1)).alias("unique_values"))
        stats = stats.join(distinct, [*C.FRAME, "sensor"], "left").fillna({"unique_values": 0})
    category = sensor_class(F.col("variance"))
    useful = (category == "variable") & (F.abs("corr_with_cycle") >= C.USEFUL_CORRELATION)
    return stats.withColumns({
        "category": category, "is_potentially_useful": F.coalesce(useful, F.lit(False))})


def lifetimes(df: DataFrame) -> DataFrame:
    return df.groupBy(*C.UNIT).agg(F.max("cycle").alias("lifetime"))


def lifetime_statistics(df: DataFrame) -> DataFrame:
    """Lifetimes are whole numbers, so the exact median keeps one counter per distinct lifetime."""
    return lifetimes(df).groupBy(*C.FRAME).agg(
        F.count(F.lit(1)).alias("engines"), F.avg("lifetime").alias("mean_lifetime"),
        F.min("lifetime").alias("min_lifetime"), F.max("lifetime").alias("max_lifetime"),
        F.stddev_samp("lifetime").alias("std_lifetime"), F.median("lifetime").alias("median_lifetime"),
    )


def healthy_rows(train: DataFrame, min_rul: float = C.HEALTHY_RUL, min_rows: int = C.MIN_HEALTHY_ROWS) -> DataFrame:
    """Rows that still have at least ``min_rul`` cycles; a subset with too few of them uses early cycles."""
    counts = train.groupBy("subset").agg(F.count_if(F.col("RUL_capped") >= min_rul).alias("n_healthy"))
    by_rul = counts.select("subset", (F.col("n_healthy") >= min_rows).alias("by_rul"))
    marked = train.join(F.broadcast(by_rul), "subset")
    late = marked.filter(F.col("by_rul") & (F.col("RUL_capped") >= min_rul))
    early = first_cycles(marked.filter(~F.col("by_rul")), C.EARLY_CYCLES)
    return late.unionByName(early).drop("by_rul")


def used_sensors(train: DataFrame) -> DataFrame:
    """(subset, sensor) pairs that are neither constant nor near-constant in the training rows."""
    return sensor_variances(train).filter(F.col("category") == "variable").select("subset", "sensor")


def baseline_moments(train: DataFrame) -> DataFrame:
    """Mean and std of each sensor over the healthy rows: one wide row per subset, NULL for unused sensors.

    One aggregate has the healthy rows of all subsets. Only those of a subset with too few of them are read again for its
    early cycles, so no other row is shuffled, and no engine is ranked whole.
    """
    sensors = present(train, C.SENSORS)
    late, few = F.col("RUL_capped") >= C.HEALTHY_RUL, F.col("n_healthy") < C.MIN_HEALTHY_ROWS
    measures = lambda kind, rows: [
        f(F.when(rows, F.col(s))).alias(f"{kind}_{name}_{s}") for s in sensors for name, f in (("mean", F.avg), ("std", F.stddev_samp))]
    whole = train.groupBy("subset").agg(
        F.count_if(late).alias("n_healthy"), *[(F.var_samp(s) > C.NEAR_CONSTANT_VARIANCE).alias(f"use_{s}") for s in sensors],
        *measures("late", late))
    lacking = whole.filter(few).select(F.col("subset").alias("_lacking"))
    same = F.col("subset").eqNullSafe(F.col("_lacking"))
    early = first_cycles(train.join(F.broadcast(lacking), same, "left_semi"), C.EARLY_CYCLES).groupBy(
        F.col("subset").alias("_lacking")).agg(*measures("early", F.lit(True)))
    wide = whole.join(F.broadcast(early), same, "left").select("subset", *[f"use_{s}" for s in sensors], *[
        F.when(few, F.col(f"early_{kind}_{s}")).otherwise(F.col(f"late_{kind}_{s}")).alias(f"{kind}_{s}")
        for s in sensors for kind in ("mean", "std")])
    out = []
    for s in sensors:
        std = F.greatest(F.coalesce(F.col(f"std_{s}"), F.lit(0.0)), F.lit(C.STD_FLOOR))
        out += [F.when(F.col(f"use_{s}"), F.col(f"mean_{s}")).alias(f"mean_{s}"),
                F.when(F.col(f"use_{s}"), std).alias(f"std_{s}")]
    return wide.select("subset", *out)


def baseline_statistics(train: DataFrame) -> DataFrame:
    """Healthy baseline per (subset, sensor): mean, floored std, min, max and exact quartiles."""
    sensors = present(train, C.SENSORS)
    healthy = healthy_rows(train)
    moments = [
        F.struct(F.lit(s).alias("sensor"), F.avg(s).alias("mean"),
                 F.greatest(F.coalesce(F.stddev_samp(s), F.lit(0.0)), F.lit(C.STD_FLOOR)).alias("std"),
                 F.min(s).alias("min"), F.max(s).alias("max")).alias(s)
        for s in sensors
    ]
    stats = healthy.groupBy("subset").agg(*moments).select("subset", F.inline(F.array(*sensors)))
    quartiles = exact_percentiles(healthy, ["subset"], sensors, [0.25, 0.75]).groupBy("subset", "column").agg(
        F.max(F.when(F.col("p") == 0.25, F.col("value"))).alias("p25"),
        F.max(F.when(F.col("p") == 0.75, F.col("value"))).alias("p75"),
    ).withColumnRenamed("column", "sensor")
    return stats.join(used_sensors(train), ["subset", "sensor"]).join(quartiles, ["subset", "sensor"])


def dataset_report(labelled: DataFrame) -> DataFrame:
    """One row per subset: sizes, defects, sensor lists, lifetimes and RUL statistics."""
    train = labelled.filter(F.col("split") == "train")
    measured = [c for c in labelled.columns if c not in (*C.FRAME, "RUL", "RUL_capped")]
    gaps = F.lit(0)
    for c in measured:
        gaps = gaps + F.when(F.col(c).isNull(), 1).otherwise(0)
    is_train = F.col("split") == "train"
    sizes = labelled.withColumn("_gaps", gaps).groupBy("subset").agg(
        F.count_if(is_train).alias("train_rows"), F.count_if(~is_train).alias("test_rows"),
        F.max(F.when(is_train, F.col("cycle"))).alias("total_cycles"),
        F.coalesce(F.sum(F.when(is_train, F.col("_gaps"))), F.lit(0)).alias("train_missing"),
        F.coalesce(F.sum(F.when(~is_train, F.col("_gaps"))), F.lit(0)).alias("test_missing"),
        F.avg(F.when(is_train, F.col("RUL"))).alias("mean_RUL"),
        F.stddev_samp(F.when(is_train, F.col("RUL"))).alias("std_RUL"),
        F.min(F.when(is_train, F.col("RUL"))).alias("min_RUL"),
        F.max(F.when(is_train, F.col("RUL"))).alias("max_RUL"),
        F.avg(F.when(is_train, F.col("RUL_capped"))).alias("mean_RUL_capped"),
    )
    engines = lifetimes(labelled).groupBy("subset").agg(
        F.count_if(is_train).alias("train_engines"), F.count_if(~is_train).alias("test_engines"),
        F.avg(F.when(is_train, F.col("lifetime"))).alias("engine_lifetime_avg_cycles"),
        F.min(F.when(is_train, F.col("lifetime"))).alias("engine_lifetime_min_cycles"),
        F.max(F.when(is_train, F.col("lifetime"))).alias("engine_lifetime_max_cycles"),
    )
    copies = duplicate_rows(train, measured)
    stats = sensor_statistics(train, with_distinct=False)
    order = F.regexp_extract("sensor", r"(\d+)", 1).cast("int")

    def listed(keep):
        picked = F.sort_array(F.collect_list(F.when(keep, F.struct(order.alias("n"), F.col("sensor").alias("s")))))
        return F.array_join(F.transform(picked, lambda e: e["s"]), ",")

    # At most one entry per sensor name and subset is listed.
    lists = stats.groupBy("subset").agg(
        listed(F.col("category") == "constant").alias("constant_sensors"),
        listed(F.col("category") == "near_constant").alias("near_constant_sensors"),
        listed(F.col("is_potentially_useful")).alias("useful_sensors"),
    )
    return (
        sizes.join(engines, "subset").join(copies, "subset", "left").join(lists, "subset", "left")
        .fillna({"train_duplicates": 0})
        .withColumns({
            "n_sensors": F.lit(len(present(labelled, C.SENSORS))),
            "n_settings": F.lit(len(present(labelled, C.SETTINGS))),
        })
    )


def duplicate_rows(train: DataFrame, measured: list[str]) -> DataFrame:
    copies = train.groupBy("subset", *measured).agg(F.count(F.lit(1)).alias("_copies"))
    return copies.groupBy("subset").agg(F.sum(F.col("_copies") - 1).alias("train_duplicates"))


def run_summary(labelled: DataFrame) -> DataFrame:
    """Sizes per subset plus a grand total row."""
    is_train = F.col("split") == "train"
    engines = labelled.groupBy(*C.UNIT).agg(F.count(F.lit(1)).alias("rows"))
    return engines.rollup("subset").agg(
        F.sum(F.when(is_train, F.col("rows")).otherwise(0)).alias("train_rows"),
        F.sum(F.when(~is_train, F.col("rows")).otherwise(0)).alias("test_rows"),
        F.count_if(is_train).alias("engines"),
    ).withColumn("subset", F.coalesce("subset", F.lit("TOTAL")))
