"""Telemetry view over the supplied order tables.

A line item is one operating cycle of the unit ``l_suppkey``; parts and orders add sensors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from bladewatch.constants import FRAME
from bladewatch.operators.labels import ENGINE_BUCKET, add_rul
from bladewatch.operators.ordering import bucketed_ordinal, has_oversized_unit
from bladewatch.session import scratch_path, tune, unit_row_limit
from bladewatch.sources.model_store import file_state
from bladewatch.sources.stages import save_buckets, save_stage

VIEW_SENSORS = (
    "sensor_1", "sensor_2", "sensor_3", "sensor_4", "sensor_7", "sensor_8", "sensor_9", "sensor_11",
)
VIEW_SETTINGS = ("setting_1", "setting_2", "setting_3")
_CYCLE_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")

INPUTS = ("lineitem", "orders", "part", "supplier")  # what the view reads

JOINED = {  # sensors of the joined tables, by the key of a line item
    "l_partkey": ("part", "p_partkey", {"sensor_4": "p_retailprice", "sensor_8": "p_size"}),
    "l_orderkey": ("orders", "o_orderkey", {"sensor_7": "o_totalprice"}),
}

_hot_units: dict[tuple, bool] = {}
_repeated: dict[tuple, frozenset] = {}
_stages: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """This session, the row limit, and the state of the input files; changes when any of them is written anew."""
    state = file_state(spark, [f"{sf_dir}/{t}.parquet" for t in INPUTS])
    return spark.sparkContext.applicationId, sf_dir, unit_row_limit(spark), *state


def hot_units(spark: SparkSession, sf_dir: str) -> bool:
    """Whether any unit of this data set is too large for one task (measured once per session and state of the files)."""
    key = _state(spark, sf_dir)
    if key not in _hot_units:
        _hot_units[key] = has_oversized_unit(table(spark, sf_dir, "lineitem"), ["l_suppkey"])
    return _hot_units[key]


def unit_columns(supplier) -> dict:
    return {
        "subset": F.concat(F.lit("FD00"), (F.pmod(supplier, F.lit(4)) + 1).cast("string")),
        "split": F.when(F.pmod(F.floor(supplier / F.lit(4)), F.lit(2)) == 0, F.lit("train")).otherwise(F.lit("test")),
        "engine_id": (supplier + 1).cast("long"),
    }


def repeated_keys(spark: SparkSession, sf_dir: str) -> frozenset:
    """The keys of line items that come twice in the table joined by them, so that the join makes rows (measured once)."""
    key = _state(spark, sf_dir)
    if key not in _repeated:
        _repeated[key] = frozenset(
            by for by, (name, own, _) in JOINED.items()
            if not table(spark, sf_dir, name).filter(F.col(own).isNotNull()).groupBy(own).count().filter("count > 1").isEmpty())
    return _repeated[key]


def _view(spark: SparkSession, sf_dir: str, sensors=VIEW_SENSORS) -> DataFrame:
    """Cycle-level telemetry worked out from the order tables; a table without an asked sensor is joined only if that makes
    rows."""
    items = table(spark, sf_dir, "lineitem")
    for by, (name, own, given) in JOINED.items():
        if set(given) & set(sensors) or by in repeated_keys(spark, sf_dir):
            items = items.join(table(spark, sf_dir, name).select(F.col(own).alias(by), *given.values()), by, "left")
    units = items.withColumns(unit_columns(F.col("l_suppkey")))
    if hot_units(spark, sf_dir):
        day = F.date_trunc("day", "l_shipdate")
        cycled = bucketed_ordinal(
            units, [*FRAME, "engine_id"], day, [F.col(c) for c in _CYCLE_ORDER], "cycle")
    else:
        order = Window.partitionBy(*FRAME, "engine_id").orderBy(*_CYCLE_ORDER)
        cycled = units.withColumn("cycle", F.row_number().over(order).cast("long"))
    formulas = {
        "sensor_1": F.lit(518.67),
        "sensor_2": F.col("l_quantity"),
        "sensor_3": F.col("l_extendedprice"),
        "sensor_4": F.col("p_retailprice"),
        "sensor_7": F.col("o_totalprice"),
        "sensor_8": F.col("p_size").cast("double"),
        "sensor_9": F.col("l_quantity") + F.lit(0.05) * F.col("cycle"),
        "sensor_11": F.col("l_extendedprice") / F.col("l_quantity"),
    }
    return cycled.select(
        *FRAME, "engine_id", "cycle",
        F.col("l_discount").alias("setting_1"), F.col("l_tax").alias("setting_2"),
        F.col("l_linenumber").cast("double").alias("setting_3"),
        *[formulas[s].alias(s) for s in VIEW_SENSORS if s in sensors],
    )


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known RUL of the test units, in engine order: (subset, engine_ordinal, true_rul)."""
    units = table(spark, sf_dir, "supplier").withColumns(unit_columns(F.col("s_suppkey")))
    test = units.filter(F.col("split") == "test").withColumn(
        "true_rul", F.pmod(F.floor(F.abs("s_acctbal")), F.lit(146)).cast("long"))
    bucket = F.floor(F.col("engine_id") / F.lit(ENGINE_BUCKET))
    numbered = bucketed_ordinal(test, ["subset"], bucket, [F.col("engine_id")], "engine_ordinal")
    return numbered.select("subset", "engine_ordinal", "true_rul")


def labelled(spark: SparkSession, sf_dir: str, sensors=VIEW_SENSORS) -> DataFrame:
    """Telemetry with labels, read from a stage table by subset and split, in order of engine.

    The table is written once per session and state of the input files. So a query reads it by column, frame and engine,
    and the chain of joins and windows behind it runs once, however many parts of a query ask for it. Engines are in buckets,
    but for those too large for one task.
    """
    key = _state(spark, sf_dir)
    if key not in _stages:
        rows, root = add_rul(_view(spark, sf_dir), ground_truth(spark, sf_dir), split_hot=hot_units(spark, sf_dir)), scratch_path(
            spark, "labelled")
        if hot_units(spark, sf_dir):
            found = tune(spark).read.schema(rows.schema).parquet(save_stage(rows, root, "labelled"))
        else:
            found = save_buckets(rows, root, "labelled", table(spark, sf_dir, "lineitem").count())
        _stages[key] = found.select(*rows.columns)
    unasked = [s for s in VIEW_SENSORS if s not in sensors]
    tune(spark)
    return _stages[key].select(*[c for c in _stages[key].columns if c not in unasked])


def telemetry(spark: SparkSession, sf_dir: str, sensors=VIEW_SENSORS) -> DataFrame:
    """Cycle-level telemetry with the asked sensors, from the stage table."""
    return labelled(spark, sf_dir, sensors).drop("RUL", "RUL_capped")


def unlabelled(spark: SparkSession, sf_dir: str, sensors=VIEW_SENSORS) -> DataFrame:
    """As ``telemetry``, for one pass: from the stage table if this session has it, else worked out without labels and not
    written."""
    if _state(spark, sf_dir) in _stages:
        return telemetry(spark, sf_dir, sensors)
    return _view(spark, sf_dir, sensors)


def settings_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles and settings, without labels and sensors; if not from the stage table, of the line items alone, with one exchange
    by engine."""
    return unlabelled(spark, sf_dir, sensors=())


def dirty_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The telemetry view with rule-made defects: infinities, NaN, empty rows, copies and bad keys."""
    df = telemetry(spark, sf_dir)
    line, quantity = F.col("setting_3"), F.col("sensor_2")
    measured = [c for c in df.columns if c not in FRAME]
    defects = df.withColumns({
        "sensor_2": F.when((line == 3.0) & (quantity == 13.0), F.lit(float("inf")))
        .when((line == 4.0) & (quantity == 17.0), F.lit(float("-inf"))).otherwise(quantity),
        "sensor_3": F.when((line == 2.0) & (quantity == 7.0), F.lit(float("nan"))).otherwise(F.col("sensor_3")),
        "engine_id": F.when((line == 1.0) & (quantity == 29.0), F.lit(-1)).otherwise(F.col("engine_id")),
        "cycle": F.when((line == 1.0) & (quantity == 31.0), F.lit(0)).otherwise(F.col("cycle")),
    })
    empty = (line == 5.0) & (quantity == 50.0)
    blanked = defects.select(*FRAME, *[F.when(~empty, F.col(c)).alias(c) for c in measured])
    copies = F.when(line == 7.0, 2).otherwise(1)
    return blanked.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy")
