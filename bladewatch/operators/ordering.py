"""Exact ordinals, engine layout checks and running sums that never pull one group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bladewatch.constants import UNIT
from bladewatch.session import unit_row_limit


def bucketed_ordinal(df: DataFrame, group: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """1-based position inside ``group`` by (bucket, order).

    The rank is taken inside small (group, bucket) pieces and shifted by the row counts of the
    earlier buckets, so a single large group spreads over as many tasks as it has buckets.
    ``order`` must be total inside a bucket and ``bucket`` must follow it.
    """
    pieces = df.withColumn("_bucket", bucket)
    keys = [*group, "_bucket"]
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        pieces.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        pieces.join(offsets, keys)
        .withColumn(name, (F.col("_offset") + inside).cast("long"))
        .drop("_bucket", "_offset")
    )


def has_oversized_unit(df: DataFrame, keys=UNIT, limit: int | None = None) -> bool:
    """True when one engine holds more rows than a single task should sort.

    One partial-aggregated count over the key columns; only a single number reaches the driver.
    """
    limit = limit or unit_row_limit(df.sparkSession)
    top = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()
    return top is not None and top["n"] is not None and top["n"] > limit


def running_sums(df: DataFrame, keys: list[str], order: str, columns: list[str], block: int | None) -> DataFrame:
    """Replaces each column by its running sum over ``keys`` by ``order``; rows with equal order share it.

    With ``block``, sums run inside blocks of the order value and are shifted by the totals of the earlier
    blocks, so a large key is spread over many tasks.
    """
    if block is None:
        whole = Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
        return df.withColumns({c: F.coalesce(F.sum(c).over(whole), F.lit(0.0)) for c in columns})
    cells = [*keys, "_block"]
    blocks = df.withColumn("_block", F.floor(F.col(order) / F.lit(block)))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy(*cells).agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
    shifts = totals.select(
        *cells, *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0.0)).alias(f"_s_{c}") for c in columns])
    inside = Window.partitionBy(*cells).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    out = blocks.join(shifts, cells)
    return out.withColumns({
        c: F.col(f"_s_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0.0)) for c in columns
    }).drop("_block", *[f"_s_{c}" for c in columns])


def first_mark_from(points: DataFrame, marks: DataFrame, keys: list[str], order: str, name: str,
                    block: int | None) -> DataFrame:
    """For each point the smallest mark at or after it (NULL if none), without pairing points and marks.

    With ``block``: the nearest mark inside the point's own block of the order value, else the first mark of a
    later block, so a large key is spread over many tasks.
    """
    cells = [*keys, "_block"]
    block_of = F.lit(0) if block is None else F.floor(F.col(order) / F.lit(block))
    both = points.withColumn("_mark", F.lit(None).cast("long")).withColumn("_point", F.lit(True)).unionByName(
        marks.select(*keys, order).withColumn("_mark", F.col(order).cast("long")).withColumn("_point", F.lit(False)),
        allowMissingColumns=True).withColumn("_block", block_of)
    ahead = Window.partitionBy(*cells).orderBy(order).rangeBetween(0, Window.unboundedFollowing)
    later = Window.partitionBy(*keys).orderBy("_block").rowsBetween(1, Window.unboundedFollowing)
    if block is None:
        return both.withColumn(name, F.min("_mark").over(ahead)).filter("_point").drop("_mark", "_point", "_block")
    firsts = both.groupBy(*cells).agg(F.min("_mark").alias("_first")).withColumn(
        "_later", F.min("_first").over(later)).drop("_first")
    near = both.withColumn("_near", F.min("_mark").over(ahead)).filter("_point")
    return near.join(firsts, cells, "left").withColumn(name, F.coalesce("_near", "_later")).drop(
        "_mark", "_point", "_block", "_near", "_later")
