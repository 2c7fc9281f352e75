"""Stage tables and exports."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from bladewatch.constants import FRAME
from bladewatch.session import DEFAULT_UNIT_ROWS, scratch_path

ENGINE_CELLS = 64  # of a subset and split
BUCKET_ROWS = 250_000  # of one bucket of engines, about
LEAST_BUCKETS = 16
STAGES = ("cleaned", "processed", "features", "predictions", "summaries")


class StageMissing(FileNotFoundError):
    """The stage table has not been written yet."""


def save_stage(df: DataFrame, root: str, stage: str, dealt: bool = False) -> str:
    """Parquet partitioned by subset and split; files sorted by engine so row groups can be skipped.

    Engines are dealt to ENGINE_CELLS cells of a frame first, so a frame has few files and no task has a whole frame; a
    very long engine is dealt by blocks of its cycles. With ``dealt``, engines lie together already, as in ``save_buckets``.
    """
    path = f"{root}/{stage}"
    keys = [c for c in FRAME if c in df.columns]
    order = [c for c in ("engine_id", "cycle") if c in df.columns]
    if "engine_id" in df.columns and not dealt:
        block = [F.floor(F.col("cycle") / F.lit(DEFAULT_UNIT_ROWS))] if "cycle" in df.columns else []
        df = df.repartition(*keys, F.pmod(F.xxhash64("engine_id", *block), F.lit(ENGINE_CELLS)))
    df.sortWithinPartitions(*keys, *order).write.mode("overwrite").partitionBy(*keys).parquet(path)
    return path


def save_buckets(df: DataFrame, root: str, stage: str, rows: int) -> DataFrame:
    """As ``save_stage``, with whole engines dealt to buckets, whose number follows the number of ``rows``; returns the table.

    Spark knows where an engine is, so windows over engines need no exchange, whenever the table is read. Not for engines
    that are too large for one task.
    """
    buckets, name = max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS)), f"{stage}_{uuid.uuid4().hex}"
    df.repartition(buckets, "engine_id").write.format("parquet").partitionBy(*FRAME).bucketBy(buckets, "engine_id").sortBy(
        "engine_id", "cycle").option("path", f"{root}/{stage}").saveAsTable(name)
    return df.sparkSession.table(name)


def load_stage(spark: SparkSession, root: str, stage: str, subset: str | None = None,
               split: str | None = None) -> DataFrame:
    """Stage table with partition filters; a missing one says which pipeline step writes it."""
    try:
        df = spark.read.parquet(f"{root}/{stage}")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        raise StageMissing(f"no {stage} table under {root}: run the data pipeline first") from error
    if subset is not None:
        df = df.filter(F.col("subset") == subset)
    if split is not None:
        df = df.filter(F.col("split") == split)
    return df


def load_model_inputs(spark: SparkSession, root: str, subset: str | None = None) -> DataFrame:
    """Feature frames when present, else the processed frames."""
    try:
        return load_stage(spark, root, "features", subset)
    except StageMissing:
        return load_stage(spark, root, "processed", subset)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    """JSON lines, one record per row; nested reports keep their structure."""
    df.write.mode("overwrite").json(path)


def export_documents(df: DataFrame, path: str, name: str) -> None:
    """One JSON document per row below ``path/name``, in a folder for each subset; rows are bounded reports."""
    df.repartition("subset").write.mode("overwrite").option("ignoreNullFields", False).partitionBy("subset").json(f"{path}/{name}")


def load_documents(spark: SparkSession, path: str, name: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/{name}")


def report_records(df: DataFrame, report_type: str = "fleet") -> DataFrame:
    """Report download: each record with the report's type and total, so the list is never held in one row."""
    total = df.agg(F.count(F.lit(1)).alias("total_records"))
    return df.select(F.struct(*df.columns).alias("data")).join(F.broadcast(total)).select(
        F.lit(report_type).alias("report_type"), "total_records", "data")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes a frame that several passes read to the shared folder and reads it back."""
    path = scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
