"""Operating regimes and normalisation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from bladewatch import constants as C
from bladewatch.operators.features import present
from bladewatch.sources.stages import materialise


MOST_ROUNDS = 50  # of moving centres
SETTLED = 1e-12  # a start has settled once no centre moves further than its square root


def distinct_points(train: DataFrame) -> DataFrame:
    """(subset, point, weight): equal setting vectors merged into one weighted point; rows without a setting are left out.

    The objective stays the same, and the repeated passes run over the distinct operating points instead of all cycles.
    """
    settings = present(train, C.SETTINGS)
    return train.dropna(subset=settings).groupBy("subset", *settings).agg(F.count(F.lit(1)).cast("double").alias("weight")).select(
        "subset", F.array(*(F.col(c).cast("double") for c in settings)).alias("point"), "weight")


def _draw(points: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) for each point and salt, the same wherever the point lies."""
    state = np.full(len(points), (salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for column in (points + 0.0).T:  # so that -0.0 is 0.0
        state = (state ^ np.ascontiguousarray(column).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        state ^= state >> np.uint64(29)
    return ((state >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def _gaps(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance of every point to every centre."""
    return ((points[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)


def _by_subset(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    for frame in frames:
        for subset, part in frame.groupby("subset"):
            yield subset, np.array(part["point"].tolist(), float), part["weight"].to_numpy(float)


def _next_centres(points: DataFrame, centres: dict, starts: int, seed: int) -> dict:
    """One more centre for each (subset, start): a point drawn by weight times squared distance to the nearest centre.

    Each task races its own points and hands on one row a subset and start.
    """
    held = points.sparkSession.sparkContext.broadcast(centres)

    def race(frames):
        for subset, at, weight in _by_subset(frames):
            for start in range(starts):
                known = held.value.get((subset, start), [])
                far = weight * (_gaps(at, np.array(known)).min(axis=1) if known else 1.0)
                time = np.divide(-np.log(_draw(at, seed + 1009 * start + len(known))), far, out=np.full(len(at), np.inf), where=far > 0)
                first = int(np.lexsort((*at.T, time))[0])
                if np.isfinite(time[first]):
                    yield pd.DataFrame({"subset": [subset], "start": [start], "time": [time[first]], "point": [at[first].tolist()]})

    rows = points.mapInPandas(race, "subset string, start int, time double, point array<double>").groupBy("subset", "start").agg(
        F.min(F.struct("time", "point"))["point"].alias("point")).collect()
    return {(r["subset"], r["start"]): [*centres.get((r["subset"], r["start"]), []), list(r["point"])] for r in rows}


def _moved(points: DataFrame, centres: dict) -> tuple[dict, dict]:
    """(centres moved to the mean of their points, cost of the centres before) of every (subset, start)."""
    held = points.sparkSession.sparkContext.broadcast(centres)

    def sums(frames):
        for subset, at, weight in _by_subset(frames):
            for (name, start), known in held.value.items():
                if name != subset:
                    continue
                gaps = _gaps(at, np.array(known))
                nearest = gaps.argmin(axis=1)
                cost = weight * gaps.min(axis=1)
                yield pd.DataFrame([
                    (subset, start, k, weight[m].sum(), cost[m].sum(), (weight[m, None] * at[m]).sum(axis=0).tolist())
                    for k in np.unique(nearest).tolist() for m in [nearest == k]],
                    columns=["subset", "start", "k", "weight", "cost", "total"])

    width = len(next(iter(centres.values()))[0])
    rows = points.mapInPandas(
        sums, "subset string, start int, k int, weight double, cost double, total array<double>").groupBy(
        "subset", "start", "k").agg(F.sum("weight").alias("weight"), F.sum("cost").alias("cost"),
                                    F.array(*(F.sum(F.col("total")[i]) for i in range(width))).alias("total")).collect()
    moved, cost = {key: [list(c) for c in known] for key, known in centres.items()}, dict.fromkeys(centres, 0.0)
    for r in rows:  # a centre without points stays where it is
        key = (r["subset"], r["start"])
        moved[key][r["k"]] = [t / r["weight"] for t in r["total"]]
        cost[key] += r["cost"]
    return moved, cost


def fit_subset_regimes(train: DataFrame, regimes: dict | None = None, n_init: int = 10, seed: int = C.SEED) -> dict:
    """Cluster centres per subset found in ``train``: the best of ``n_init`` k-means runs on its settings.

    ``regimes`` names the number of regimes of a subset; one that it doesn't name, or names with one, has no centres.
    All subsets and starts are fitted together: one aggregate per round. The driver holds subsets x starts x regimes centres.
    """
    regimes = C.SUBSET_REGIMES if regimes is None else regimes
    wanted = {s: k for s, k in regimes.items() if k > 1}
    points = materialise(distinct_points(train), "operating-points")
    found = {r["subset"] for r in points.select("subset").distinct().collect()}
    subsets = {r["subset"] for r in train.select("subset").distinct().collect()}
    centres = {s: [] for s in sorted(subsets, key=lambda s: (s is None, s))}
    points = points.filter(F.col("subset").isin(*wanted))
    moving = {}
    for k in range(1, max((wanted[s] for s in wanted if s in found), default=0) + 1):
        more = {s for s in found if wanted.get(s, 0) >= k}
        grown = _next_centres(points.filter(F.col("subset").isin(*more)), {
            key: c for key, c in moving.items() if key[0] in more}, n_init, seed)
        moving |= grown
    best = {}
    for _ in range(MOST_ROUNDS):
        if not moving:
            break
        moved, cost = _moved(points, moving)
        for (subset, start), c in cost.items():
            best[(subset, start)] = (c, start, moving[(subset, start)])
        moving = {key: to for key, to in moved.items() if max(
            sum((a - b) ** 2 for a, b in zip(x, y)) for x, y in zip(to, moving[key])) > SETTLED}
    for subset in {s for s, _ in best}:
        centres[subset] = min(v for (s, _), v in best.items() if s == subset)[2]
    return centres


@dataclass
class Normaliser:
    """Fitted regimes and their statistics."""

    centres: dict[str, list[list[float]]]
    statistics: DataFrame

    @classmethod
    def fit(cls, train: DataFrame, centres: dict | None = None) -> Normaliser:
        centres = fit_subset_regimes(train) if centres is None else centres
        return cls(centres, regime_statistics(assign_regime(train, centres)))

    def transform(self, df: DataFrame) -> DataFrame:
        """The frame in z-scores of each row's own regime, with ``_regime``."""
        return normalise(assign_regime(df, self.centres), self.statistics)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(list(self.centres.items()), "subset string, centres array<array<double>>").write.mode(
            "overwrite").parquet(f"{path}/centres")
        self.statistics.write.mode("overwrite").parquet(f"{path}/statistics")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Normaliser:
        centres = {r["subset"]: [list(c) for c in r["centres"]] for r in spark.read.parquet(f"{path}/centres").collect()}
        return cls(centres, spark.read.parquet(f"{path}/statistics"))


def assign_regime(df: DataFrame, models: dict[str, list[list[float]]]) -> DataFrame:
    """Adds ``_regime``: the nearest centre of the row's subset, 0 where a subset has no centres."""
    settings = present(df, C.SETTINGS)
    regime = F.lit(0)
    for subset, centres in models.items():
        if not centres:
            continue
        options = []
        for i, centre in enumerate(centres):
            distance = F.lit(0.0)
            for name, value in zip(settings, centre):
                gap = F.col(name) - F.lit(float(value))
                distance = distance + gap * gap
            options.append(F.struct(distance.alias("d"), F.lit(i).alias("i")))
        regime = F.when(F.col("subset") == subset, F.array_min(F.array(*options))["i"]).otherwise(regime)
    return df.withColumn("_regime", regime)


def regime_statistics(train: DataFrame) -> DataFrame:
    """Mean and std per (subset, regime): wide row, NULL for sensors that hardly vary in the subset."""
    sensors = present(train, C.SENSORS)
    active = train.groupBy("subset").agg(*[(F.var_samp(s) > C.ACTIVE_VARIANCE).alias(f"use_{s}") for s in sensors])
    wide = train.groupBy("subset", "_regime").agg(
        *[F.avg(s).alias(f"mean_{s}") for s in sensors], *[F.stddev_samp(s).alias(f"std_{s}") for s in sensors])
    out = []
    for s in sensors:
        std = F.when(F.col(f"std_{s}") >= C.STD_FLOOR, F.col(f"std_{s}")).otherwise(F.lit(1.0))
        use = F.col(f"use_{s}")
        out += [F.when(use, F.col(f"mean_{s}")).alias(f"mean_{s}"), F.when(use, std).alias(f"std_{s}"),
                use.alias(f"use_{s}")]
    return wide.join(F.broadcast(active), "subset").select("subset", "_regime", *out)


def normalise(df: DataFrame, statistics: DataFrame) -> DataFrame:
    """Active sensors become z-scores of their regime; a regime unseen in training keeps raw values.

    ``statistics`` has one row per (subset, regime), which the regime counts bound, so it is broadcast.
    """
    sensors = present(df, C.SENSORS)
    active = statistics.groupBy("subset").agg(*[F.bool_or(f"use_{s}").alias(f"use_{s}") for s in sensors])
    joined = (
        df.join(F.broadcast(active), "subset", "left")
        .join(F.broadcast(statistics.drop(*[f"use_{s}" for s in sensors])), ["subset", "_regime"], "left")
    )
    out = {}
    for s in sensors:
        mean = F.coalesce(F.col(f"mean_{s}"), F.lit(0.0))
        std = F.coalesce(F.col(f"std_{s}"), F.lit(1.0))
        out[s] = F.when(F.coalesce(F.col(f"use_{s}"), F.lit(False)), (F.col(s) - mean) / std).otherwise(F.col(s))
    return joined.withColumns(out).select(*df.columns)


def scale(df: DataFrame, train: DataFrame, mode: str = "minmax") -> DataFrame:
    """Plain min-max or standard scaling of settings and sensors with bounds from the training rows."""
    columns = present(df, C.SETTINGS) + present(df, C.SENSORS)
    if mode == "minmax":
        pairs = [(F.min(c), F.max(c) - F.min(c)) for c in columns]
    elif mode == "standard":
        pairs = [(F.avg(c), F.stddev_pop(c)) for c in columns]
    else:
        raise ValueError(f"unknown scaler {mode!r}")
    aggregates = []
    for c, (shift, span) in zip(columns, pairs):
        aggregates += [shift.alias(f"shift_{c}"), span.alias(f"span_{c}")]
    bounds = train.groupBy("subset").agg(*aggregates)
    joined = df.join(F.broadcast(bounds), "subset", "left")
    scaled = {
        c: (F.col(c) - F.col(f"shift_{c}"))
        / F.when(F.col(f"span_{c}") > 0.0, F.col(f"span_{c}")).otherwise(F.lit(1.0))
        for c in columns
    }
    return joined.withColumns(scaled).select(*df.columns)
