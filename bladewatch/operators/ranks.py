"""Exact order statistics of many cells (group, column) at once, by histograms over shrinking ranges.

Doubles are read as whole numbers in the same order. Each round counts the values of every open range in BINS parts of
it; the part that holds a wanted rank becomes the next range, between its smallest and largest value. A range of one
value is the answer. Rounds grow with the logarithm of the rows to the base BINS; no cell is ever sorted or held whole,
and what reaches the driver is bounded by cells x ranks x BINS, whatever the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from bladewatch.sources.stages import materialise

BINS = 256
_LOW = -(1 << 63)


@dataclass
class Range:
    """Values of one cell between two keys; ``below`` of the cell's values are smaller."""

    group: int
    column: int
    low: int
    high: int
    below: int = 0

    @property
    def width(self) -> int:  # of one part
        return -(-(self.high - self.low + 1) // BINS)


def keys_of(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values; -0.0 is 0.0."""
    bits = (np.asarray(values, float) + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64((1 << 63) - 1))


def value_of(key: int) -> float:
    key = np.array([key], np.int64)
    return float((key ^ ((key >> 63) & np.int64((1 << 63) - 1))).view(float)[0])


def _histograms(rows: DataFrame, columns: list[str], ranges: list[Range]) -> dict[int, list]:
    """Per range its parts with values: (part, number, smallest key, largest key), in order."""
    held = rows.sparkSession.sparkContext.broadcast([(r.group, r.column, r.low, r.high, r.width) for r in ranges])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        for batch in batches:
            groups = batch.column(0).to_numpy(zero_copy_only=False)
            keys = {}
            for at, (group, column, low, high, width) in enumerate(held.value):
                if column not in keys:
                    values = batch.column(1 + column).to_numpy(zero_copy_only=False)
                    known = ~np.isnan(values)
                    keys[column] = groups[known], keys_of(values[known])
                own, key = keys[column]
                key = key[(own == group) & (key >= low) & (key <= high)]
                if not len(key):
                    continue
                part = ((key.astype(np.uint64) - np.uint64(low & 0xFFFFFFFFFFFFFFFF)) // np.uint64(width)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                part, key = part[order], key[order]
                starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                for p, n, a, b in zip(part[starts].tolist(), np.diff(np.r_[starts, len(part)]).tolist(),
                                      np.minimum.reduceat(key, starts).tolist(), np.maximum.reduceat(key, starts).tolist()):
                    entry = found.setdefault((at, p), [0, a, b])
                    entry[0], entry[1], entry[2] = entry[0] + n, min(entry[1], a), max(entry[2], b)
        cells = [(*k, *v) for k, v in found.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([c[i] for c in cells], pa.int64()) for i in range(5)], ["at", "part", "n", "low", "high"])

    parts = rows.mapInArrow(count, "at long, part long, n long, low long, high long").groupBy("at", "part").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("at", "part")
    out: dict[int, list] = {}
    for r in parts.collect():
        out.setdefault(r["at"], []).append((r["n"], r["low"], r["high"]))
    return out


def order_statistics(rows: DataFrame, columns: list[str], wanted: dict[tuple[int, int], set[int]]) -> dict:
    """(group, column, rank) -> value, ranks from 0; ``rows`` has a whole-number group first, then the columns as doubles."""
    open_ = {(g, c, rank): Range(g, c, _LOW, -_LOW - 1) for (g, c), ranks in wanted.items() for rank in ranks}
    out = {}
    while open_:
        ranges = list({(r.group, r.column, r.low, r.high): r for r in open_.values()}.values())
        place = {(r.group, r.column, r.low, r.high): k for k, r in enumerate(ranges)}
        parts = _histograms(rows, columns, ranges)
        following = {}
        for key, r in open_.items():
            below = r.below
            for n, low, high in parts[place[r.group, r.column, r.low, r.high]]:
                if key[2] < below + n:
                    break
                below += n
            if low == high:
                out[key] = value_of(low)
            else:
                following[key] = Range(r.group, r.column, low, high, below)
        open_ = following
    return out


def exact_percentiles(df: DataFrame, group: list[str], columns: list[str], probabilities: list[float]) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per (group, column, probability): ``column, p, value``.

    The frame is computed once. NULL and NaN are left out; a cell without values has no row. Groups should be few, as each
    round counts parts per group and column.
    """
    spark = df.sparkSession
    numbers = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns]
    kept = materialise(df.select(*group, *numbers), "rank-input")
    sizes = kept.groupBy(*group).agg(*[F.count(c).alias(f"n_{k}") for k, c in enumerate(columns)]).collect()
    names = spark.createDataFrame(
        [(*r[:len(group)], k) for k, r in enumerate(sizes)],
        StructType([*(kept.schema[g] for g in group), *StructType.fromDDL("_g long").fields]))
    same = [kept[g].eqNullSafe(names[g]) for g in group]
    rows = kept.join(F.broadcast(names), same).select("_g", *(kept[c] for c in columns))
    wanted: dict[tuple[int, int], set[int]] = {}
    for k, r in enumerate(sizes):
        for c in range(len(columns)):
            if n := r[f"n_{c}"]:
                wanted[k, c] = {f(p * (n - 1)) for p in probabilities for f in (math.floor, math.ceil)}
    found = order_statistics(rows, columns, wanted)
    out = []
    for (k, c) in wanted:
        for p in probabilities:
            rank = p * (sizes[k][f"n_{c}"] - 1)
            low, high = found[k, c, math.floor(rank)], found[k, c, math.ceil(rank)]
            between = low if low == high else low + (high - low) * (rank - math.floor(rank))
            out.append((*sizes[k][:len(group)], columns[c], p, between))
    return spark.createDataFrame(out, StructType([
        *(kept.schema[g] for g in group), StructField("column", StringType()), StructField("p", DoubleType()),
        StructField("value", DoubleType())]))
