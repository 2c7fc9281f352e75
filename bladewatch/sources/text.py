"""Raw telemetry and ground-truth text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from bladewatch.constants import RAW_COLUMNS, SENSORS, SETTINGS
from bladewatch.operators.ordering import bucketed_ordinal

# File names (fixed values): train_FD001.txt, test_FD001.txt, RUL_FD001.txt.
TELEMETRY_NAME = r"(train|test)_(FD\d+)"
TRUTH_NAME = r"RUL_(FD\d+)"
FILE_LINES = 1_000_000  # of a written file, at most; compressed, it is read by one task


def _records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All lines with their fields and what is wrong with them: NULL for a good record, ``blank`` for a line to skip."""
    lines = spark.read.text(path).select(
        F.trim(F.regexp_replace("value", r"\s+", " ")).alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    fields = lines.withColumn("f", F.split("line", " ")).withColumn(
        "n", F.transform("f", lambda x: x.try_cast("double")))
    whole = lambda x: x.isNotNull() & (x == F.floor(x)) & (F.abs(x) < 2.0**53)
    columns = len(RAW_COLUMNS)
    problem = (
        F.when(F.col("line") == "", "blank")
        .when(F.size("f") != columns, F.concat(F.lit(f"expected {columns} columns, found "), F.size("f").cast("string")))
        .when(F.exists("n", lambda x: x.isNull()), "not a number")
        .when(~whole(F.col("n")[0]) | ~whole(F.col("n")[1]), "not a whole number"))
    return fields.withColumn("problem", problem)


def read_telemetry(spark: SparkSession, path: str | list[str], strict: bool = True) -> DataFrame:
    """Whitespace-separated records; subset and split come from the file name.

    Blank lines are skipped and trailing blanks ignored. A bad record (another column count than 26, a cell that is no
    number, a fractional id) fails the job when it is read (``strict``); else it is left to ``bad_records``.
    """
    records = _records(spark, path).filter(F.col("line") != "")  # a filter on the problem would parse each line over again
    good = F.col("problem").isNull()
    if strict:
        message = F.concat("problem", F.lit(" in "), "file")
        numbers = F.when(good, F.col("n")).otherwise(F.raise_error(message).cast("array<double>"))
    else:
        numbers = F.explode(F.when(good, F.array("n")))
    cells = records.select("file", numbers.alias("n"))
    return cells.select(
        F.regexp_extract("file", TELEMETRY_NAME, 2).alias("subset"),
        F.regexp_extract("file", TELEMETRY_NAME, 1).alias("split"),
        F.col("n")[0].cast("long").alias("engine_id"), F.col("n")[1].cast("long").alias("cycle"),
        *[F.col("n")[2 + i].alias(c) for i, c in enumerate((*SETTINGS, *SENSORS))])


def bad_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_number, problem, line) of every record that ``read_telemetry`` cannot read, lines counted from 1.

    A block is read in order by one task, so its first row and the lines of the blocks before it give each line's number:
    one row per block is aggregated, and only bad lines are joined.
    """
    records = _records(spark, path)
    blocks = records.groupBy("file", "start").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("lines"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("lines").over(earlier), F.lit(0))).drop("lines")
    bad = records.filter(F.col("problem").isNotNull() & (F.col("problem") != "blank"))
    return bad.join(blocks, ["file", "start"]).select(
        "file", (F.col("before") + F.col("row") - F.col("first") + 1).alias("line_number"), "problem", "line")


def record_counts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, lines, blank, good, bad): what became of the lines of every file that has any."""
    problem = F.col("problem")
    return _records(spark, path).groupBy("file").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(problem.eqNullSafe("blank")).alias("blank"),
        F.count_if(problem.isNull()).alias("good"),
        F.count_if(problem.isNotNull() & (problem != "blank")).alias("bad"))


def read_truth(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(subset, engine_ordinal, true_rul): the i-th non-blank line of a file belongs to its i-th engine.

    The line number is built from the start of each file block and the row order inside it, so a long file
    is still read by many tasks.
    """
    lines = spark.read.text(path).select(
        F.trim("value").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    numbered = bucketed_ordinal(
        lines.filter(F.col("line") != ""), ["file"], F.col("start"), [F.col("row")], "engine_ordinal")
    return numbered.select(
        F.regexp_extract("file", TRUTH_NAME, 1).alias("subset"), "engine_ordinal",
        F.col("line").cast("double").cast("long").alias("true_rul"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Writes (name, value) as compressed text files of a bounded length, one folder per name."""
    lines.write.mode("overwrite").option("compression", "gzip").option("maxRecordsPerFile", FILE_LINES).partitionBy("name").text(path)


def write_telemetry(df: DataFrame, path: str) -> None:
    """Writes records as text, one folder per file name (``train_FD001`` ...); absent sensors become 0."""
    cells = [F.col(c).cast("string") if c in df.columns else F.lit("0.0") for c in RAW_COLUMNS]
    name = F.concat_ws("_", "split", "subset").alias("name")
    write_lines(df.select(name, F.concat_ws(" ", *cells).alias("value")), path)


def write_truth(truth: DataFrame, path: str) -> None:
    """One positional file per subset, in engine order; a file has a single writer by nature."""
    rows = truth.select(F.concat(F.lit("RUL_"), F.col("subset")).alias("name"), "engine_ordinal",
                        F.col("true_rul").cast("string").alias("value"))
    ordered = rows.repartition("name").sortWithinPartitions("name", "engine_ordinal").drop("engine_ordinal")
    ordered.write.mode("overwrite").partitionBy("name").text(path)
