"""Tables behind the charts."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from bladewatch import constants as C
from bladewatch.functions.anomaly import anomaly_severity
from bladewatch.functions.health import risk_zone
from bladewatch.functions.numeric import correlation, half_even
from bladewatch.operators.features import present
from bladewatch.operators.ordering import bucketed_ordinal
from bladewatch.operators.ranks import exact_percentiles
from bladewatch.operators.stats import sensor_statistics


def box_summary(df: DataFrame, group=("subset",)) -> DataFrame:
    """Exact five-number summary per sensor that varies."""
    sensors = present(df, C.SENSORS)
    numbers = exact_percentiles(df, list(group), sensors, [0.0, 0.25, 0.5, 0.75, 1.0])
    wide = numbers.groupBy(*group, F.col("column").alias("sensor")).agg(*[
        F.max(F.when(F.col("p") == p, F.col("value"))).alias(name)
        for p, name in ((0.0, "low"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1.0, "high"))])
    variable = df.groupBy(*group).agg(*[F.var_samp(s).alias(s) for s in sensors]).unpivot(
        list(group), sensors, "sensor", "variance").filter(F.col("variance") > C.CONSTANT_VARIANCE)
    return wide.join(variable.select(*group, "sensor"), [*group, "sensor"])


def correlation_matrix(df: DataFrame, group=("subset",)) -> DataFrame:
    """Lower triangle of the correlations among cycle and the sensors, one pass over the data."""
    columns = ["cycle", *present(df, C.SENSORS)]
    cells = []
    for i, a in enumerate(columns):
        for b in columns[:i]:
            cells.append(F.struct(F.lit(a).alias("row"), F.lit(b).alias("col"),
                                  correlation(F.col(a).cast("double"), F.col(b).cast("double")).alias("corr")
                                  ).alias(f"{a}__{b}"))
    names = [f"{a}__{b}" for i, a in enumerate(columns) for b in columns[:i]]
    wide = df.groupBy(*group).agg(*cells)
    return wide.select(*group, F.inline(F.array(*[F.col(n) for n in names]))).filter("corr is not null")


def variance_ranking(df: DataFrame, group=("subset",)) -> DataFrame:
    sensors = present(df, C.SENSORS)
    wide = df.groupBy(*group).agg(*[F.var_samp(s).alias(s) for s in sensors])
    long = wide.unpivot(list(group), sensors, "sensor", "variance").filter(F.col("variance") > 0)
    flagged = long.withColumn("near_constant", F.col("variance") <= C.NEAR_CONSTANT_VARIANCE)
    return flagged.orderBy(*group, F.col("variance").desc(), "sensor")


def first_engines(df: DataFrame, n: int) -> DataFrame:
    """The n smallest engine ids of each subset: at most subsets x n rows.

    The rank limit on distinct ids is applied before the exchange.
    """
    order = Window.partitionBy("subset").orderBy("engine_id")
    ids = df.select("subset", "engine_id").distinct()
    return ids.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= n).drop("_at")


def only_engines(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(F.broadcast(ids), ["subset", "engine_id"], "left_semi")


def mean_trend(df: DataFrame, n_engines: int = 10) -> DataFrame:
    sensors = present(df, C.SENSORS)
    chosen = only_engines(df, first_engines(df, n_engines))
    # sums are decimal, so no order of the rows moves a mean that ends in a half at its last digit
    total = {s: F.sum(F.col(s).cast("decimal(28,9)")).cast("double") for s in sensors}
    return chosen.groupBy("subset", "cycle").agg(*[F.try_divide(total[s], F.count(s)).alias(s) for s in sensors])


def degradation_curves(df: DataFrame, n_engines: int = 20) -> DataFrame:
    """Cycle curves of the sensor most correlated with cycle, for the first engines of each subset."""
    stats = sensor_statistics(df, with_distinct=False).filter(F.col("category") != "constant")
    position = F.regexp_extract("sensor", r"(\d+)", 1).cast("int")
    strength = F.coalesce(F.abs("corr_with_cycle"), F.lit(-1.0))
    best = stats.groupBy("subset").agg(
        F.max_by("sensor", F.struct(strength, -position)).alias("sensor"))
    chosen = only_engines(df, first_engines(df, n_engines)).join(F.broadcast(best), "subset")
    value = reduce(lambda acc, s: F.when(F.col("sensor") == s, F.col(s)).otherwise(acc),
                   present(df, C.SENSORS), F.lit(None).cast("double"))
    return chosen.select("subset", "engine_id", "cycle", "sensor", value.alias("value"))


def histogram(df: DataFrame, column: str, bins: int, group=("subset",)) -> DataFrame:
    """Equal-width histogram between the group's own minimum and maximum; the last bin is closed."""
    x = F.col(column).cast("double")
    bounds = df.groupBy(*group).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n"))
    spread = bounds.withColumns({
        "lo": F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")),
        "hi": F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi"))})
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    index = F.least(F.floor((x - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    counted = (
        df.select(*group, column).filter(x.isNotNull()).join(F.broadcast(spread), list(group))
        .groupBy(*group, "lo", "hi", "n", index.alias("bin")).agg(F.count(F.lit(1)).alias("frequency"))
    )
    left = F.col("lo") + F.col("bin") * width
    return counted.select(
        *group, "bin", left.alias("bin_left"), (left + width).alias("bin_right"), "frequency",
        (F.col("frequency") / (F.col("n") * width)).alias("density"))


def score_histogram(scored: DataFrame, bins: int = 50) -> DataFrame:
    """Anomaly-score histogram with the stage of each bin centre."""
    centre = (F.col("bin_left") + F.col("bin_right")) / 2.0
    return histogram(scored, "anomaly_score", bins).withColumn("stage", anomaly_severity(centre))


def operating_points(df: DataFrame, share: float = 1.0, seed: int = C.SEED) -> DataFrame:
    """Setting pairs per cycle; ``share`` < 1 keeps a hash-chosen part of the rows for drawing."""
    settings = present(df, C.SETTINGS)
    pairs = [(a, b) for i, a in enumerate(settings) for b in settings[i + 1:]]
    rows = df
    if share < 1.0:
        key = F.pmod(F.xxhash64(*C.UNIT, "cycle", F.lit(seed)), F.lit(1_000_000))
        rows = df.filter(key < int(share * 1_000_000))
    entries = [F.struct(F.lit(a).alias("x_name"), F.lit(b).alias("y_name"), F.col(a).alias("x"), F.col(b).alias("y"))
               for a, b in pairs]
    return rows.select("subset", "engine_id", "cycle", F.inline(F.array(*entries)))


def normalised_statistics(df: DataFrame) -> DataFrame:
    """Mean, std, min and max per variable sensor, each scaled to 0..1 over the sensors of the subset."""
    stats = sensor_statistics(df, with_distinct=False).filter(F.col("category") != "constant")
    names = ("mean", "std", "min", "max")
    bounds = stats.groupBy("subset").agg(*[F.min(n).alias(f"lo_{n}") for n in names],
                                         *[F.max(n).alias(f"hi_{n}") for n in names])
    scaled = {n: (F.col(n) - F.col(f"lo_{n}")) / (F.col(f"hi_{n}") - F.col(f"lo_{n}") + F.lit(1e-12)) for n in names}
    return stats.join(F.broadcast(bounds), "subset").withColumns(scaled).select("subset", "sensor", *names)


def lifetime_comparison(train: DataFrame) -> DataFrame:
    lives = train.groupBy(*C.UNIT).agg(F.max("cycle").alias("life"))
    return lives.groupBy("subset").agg(
        F.count(F.lit(1)).alias("engines"), F.avg("life").alias("mean"), F.stddev_samp("life").alias("std"),
        F.min("life").alias("min"), F.max("life").alias("max"))


def correlation_by_subset(train: DataFrame) -> DataFrame:
    """Sensor-cycle correlation side by side for every subset found; absent values are 0."""
    stats = sensor_statistics(train, with_distinct=False).filter(F.col("category") != "constant")
    wide = stats.groupBy("sensor").pivot("subset").agg(F.first("corr_with_cycle"))
    return wide.na.fill(0.0)


def status_distribution(fleet: DataFrame) -> DataFrame:
    """Engines per stage with zero rows for empty stages, and their share of the whole fleet.

    The special statuses are counted together as OTHER, so that the shares add up.
    """
    spark = fleet.sparkSession
    names = [*C.STATUSES, "OTHER"]
    totals = fleet.groupBy("subset").agg(F.count(F.lit(1)).alias("total"))
    stages = spark.createDataFrame([(s, i) for i, s in enumerate(names)], "status string, position int")
    wide = fleet.groupBy("subset").agg(
        *[F.count_if(F.col("engine_health_status") == s).alias(s) for s in C.STATUSES],
        F.count_if(~F.col("engine_health_status").isin(*C.STATUSES)).alias("OTHER"))
    counts = wide.unpivot("subset", names, "status", "engines")
    return counts.join(F.broadcast(totals), "subset").join(F.broadcast(stages), "status").select(
        "subset", "status", "position", "engines", half_even(F.col("engines") / F.col("total") * 100.0, 1).alias("pct"))


def risk_quadrant(fleet: DataFrame) -> DataFrame:
    return fleet.select(*C.UNIT, "predicted_RUL", "latest_anomaly_score", "engine_health_status",
                        risk_zone(F.col("predicted_RUL"), F.col("latest_anomaly_score")).alias("zone"))


SAMPLE_ENGINES = (1, 5, 10, 20)


def sample_timelines(cycles: DataFrame, columns: list[str], wanted=SAMPLE_ENGINES) -> DataFrame:
    """Cycles of the named engines that exist in a subset, else of its first four engines."""
    named = cycles.filter(F.col("engine_id").isin(*wanted)).select("subset", "engine_id").distinct()
    some = named.select("subset").distinct()
    fallback = first_engines(cycles, len(wanted)).join(F.broadcast(some), "subset", "left_anti")
    chosen = named.unionByName(fallback)
    return only_engines(cycles, chosen).select("subset", "engine_id", "cycle", *columns).orderBy(
        "subset", "engine_id", "cycle")


def anomalous_spans(scored: DataFrame, block: int | None = None) -> DataFrame:
    """Runs of consecutive anomalous cycles per engine, as (first_cycle, last_cycle, cycles).

    With ``block``, positions are counted in blocks of cycles, which spreads a large engine over many tasks.
    """
    hits = scored.filter(F.col("anomaly_label") == "Anomalous").select(*C.UNIT, "cycle")
    if block is None:
        at = F.row_number().over(Window.partitionBy(*C.UNIT).orderBy("cycle"))
        numbered = hits.withColumn("_at", at)
    else:
        bucket = F.floor(F.col("cycle") / F.lit(block))
        numbered = bucketed_ordinal(hits, list(C.UNIT), bucket, [F.col("cycle")], "_at")
    island = F.col("cycle") - F.col("_at")
    return numbered.groupBy(*C.UNIT, island.alias("_island")).agg(
        F.min("cycle").alias("first_cycle"), F.max("cycle").alias("last_cycle"), F.count(F.lit(1)).alias("cycles")
    ).drop("_island")


def parity(last_predictions: DataFrame) -> DataFrame:
    """True against predicted RUL at the last cycle."""
    return last_predictions.select(*C.UNIT, "true_RUL", "predicted_RUL",
                                   F.abs(F.col("predicted_RUL") - F.col("true_RUL")).alias("absolute_error"))


def principal_components(df: DataFrame, columns: list[str], k: int = 2) -> tuple[DataFrame, list[float]]:
    """Projection on the first k components (mean-centred) and their explained-variance shares."""
    filled = df.na.fill(0.0, subset=columns)
    vectors = VectorAssembler(inputCols=columns, outputCol="_raw").transform(filled)
    centred = StandardScaler(withMean=True, withStd=False, inputCol="_raw", outputCol="_centred").fit(vectors)
    model = PCA(k=k, inputCol="_centred", outputCol="_pc").fit(centred.transform(vectors))
    projected = model.transform(centred.transform(vectors)).withColumn("_pc", vector_to_array("_pc"))
    out = projected.withColumns({f"pc_{i + 1}": F.col("_pc")[i] for i in range(k)})
    return out.drop("_raw", "_centred", "_pc"), [float(x) for x in model.explainedVariance]


def array_columns(df: DataFrame, array: str, width: int) -> tuple[DataFrame, list[str]]:
    names = [f"{array}_{i}" for i in range(width)]
    cells: dict[str, Column] = {n: F.col(array)[i].cast("double") for i, n in enumerate(names)}
    return df.withColumns(cells), names
