"""Principal components of every subset's own rows, fitted together.

Each task adds up the products of its rows per subset, centred on its own means, so the rows are read once and what is
shuffled has one row per task and subset. Parts are put together with the products of the gaps between their means. The
eigenvectors are those of a small matrix, as wide as there are columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

PARTS = 64  # of the tasks' sums, before they are added up


@dataclass
class Components:
    """Fitted components per subset: means and axes (components by columns), and variances of all axes."""

    columns: list[str]
    means: dict[str, np.ndarray]
    axes: dict[str, np.ndarray]
    variances: dict[str, np.ndarray]

    def shares(self, subset: str) -> np.ndarray:
        """Share of each kept axis in the subset's variance; 0 where nothing varies."""
        total = self.variances[subset].sum()
        return self.variances[subset][:len(self.axes[subset])] / total if total > 0 else np.zeros(len(self.axes[subset]))

    def project(self, df: DataFrame) -> DataFrame:
        """Adds ``pc_1``, ``pc_2`` ...: NULL for a subset that was not fitted; a missing value counts as 0."""
        held = df.sparkSession.sparkContext.broadcast((self.means, self.axes))
        k = max((len(a) for a in self.axes.values()), default=0)

        @F.pandas_udf("array<double>")
        def projected(subset: pd.Series, points: pd.DataFrame) -> pd.Series:
            means, axes = held.value
            values, out = points.to_numpy(float), [None] * len(points)
            for name in subset.dropna().unique():
                if name in axes:
                    at = np.flatnonzero((subset == name).to_numpy())
                    for i, row in zip(at.tolist(), ((values[at] - means[name]) @ axes[name].T).tolist()):
                        out[i] = row
            return pd.Series(out, dtype=object)

        row = F.struct(*(_filled(c) for c in self.columns))
        out = df.withColumn("_pc", projected(F.col("subset"), row))
        return out.withColumns({f"pc_{i + 1}": F.get("_pc", F.lit(i)) for i in range(k)}).drop("_pc")


def _filled(c: str):
    return F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c)


def _joint(a: tuple, b: tuple) -> tuple:
    """Number, means and products of the centred rows of two parts together."""
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def fit_components(df: DataFrame, columns: list[str], k: int = 2) -> Components:
    """The first ``k`` components of each subset's rows, centred and not scaled; missing values count as 0.

    An axis points so that its largest loading is positive.
    """
    rows, d = df.select("subset", *(_filled(c) for c in columns)).filter("subset IS NOT NULL"), len(columns)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            values = np.stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(d)], axis=1)
            for name in dict.fromkeys(names):
                own = values[names == name]
                mean = own.mean(axis=0)
                part = len(own), mean, (own - mean).T @ (own - mean)
                sums[name] = _joint(sums[name], part) if name in sums else part
        yield pa.RecordBatch.from_arrays([
            pa.array(list(sums), pa.string()), pa.array([n for n, _, _ in sums.values()], pa.int64()),
            *(pa.array([s[k].ravel().tolist() for s in sums.values()], pa.list_(pa.float64())) for k in (1, 2))],
            ["subset", "n", "mean", "products"])

    def added(part: pd.DataFrame) -> pd.DataFrame:
        n, mean, total = reduce(_joint, ((n, np.asarray(m), np.asarray(p).reshape(d, d)) for n, m, p in zip(
            part["n"], part["mean"], part["products"])))
        return pd.DataFrame({"subset": part["subset"].iloc[:1], "n": [n], "mean": [mean], "products": [total.ravel()]})

    schema = "subset string, n long, mean array<double>, products array<double>"
    parts = rows.mapInArrow(products, schema).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    total = parts.groupBy("subset", "part").applyInPandas(added, schema).groupBy("subset").applyInPandas(added, schema)
    fitted = Components(list(columns), {}, {}, {})
    for r in total.collect():
        name = r["subset"]
        fitted.means[name] = np.array(r["mean"])
        values, vectors = np.linalg.eigh(np.array(r["products"]).reshape(d, d) / max(r["n"] - 1, 1))
        axes = vectors[:, ::-1].T[:k]
        largest = np.abs(axes).argmax(axis=1)
        fitted.axes[name] = axes * np.sign(axes[np.arange(len(axes)), largest])[:, None]
        fitted.variances[name] = np.maximum(values[::-1], 0.0)
    return fitted
