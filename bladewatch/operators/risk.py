"""Fleet-risk Monte Carlo.

Draws depend only on (seed, engine, simulation), so the result does not depend on partitioning, and nothing
is joined to produce them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from bladewatch import constants as C
from bladewatch.functions.accuracy import rul_bin
from bladewatch.functions.advice import engine_code, subsystem_of
from bladewatch.functions.numeric import digest, digest_normal, half_even
from bladewatch.operators.advisory import primary_fault

PARTS = 64  # of the engines, and of the tasks' sums before they are added up


def own_draws(fleet: DataFrame, n_sims: int = C.N_SIMULATIONS, seed: int = C.SEED) -> DataFrame:
    """Adds ``own``, the engine's draws of all simulations before the common shock, and their spread ``draw_std``."""
    z = F.transform(F.sequence(F.lit(0), F.lit(n_sims - 1)), lambda s: digest_normal(digest(
        F.lit(seed), F.col("engine_id"), s)))
    # A few small rows, one an engine, make thousands of draws each; left as they are they would share one task or two.
    with_z = fleet.repartition(PARTS, "engine_id").withColumn("_z", z)
    # A lambda sees plain columns only, so nothing costly can be worked out anew for every element.
    scaled = with_z.withColumn("_scale", F.lit(5.0) + F.lit(4.0) * rul_bin(F.col("predicted_RUL")))
    own = F.transform("_z", lambda x: F.greatest(F.col("predicted_RUL") + x * F.col("_scale"), F.lit(0.0)))
    count = F.lit(float(n_sims))
    spread = F.aggregate(
        "own", F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")),
        lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")),
        lambda a: F.sqrt(F.greatest(a["q"] / count - (a["s"] / count) * (a["s"] / count), F.lit(0.0))))
    return scaled.withColumn("own", own).withColumn("draw_std", spread).drop("_z", "_scale")


def _shocks(spark: SparkSession, n_sims: int, seed: int) -> np.ndarray:
    """The common shock of every simulation; as many numbers as there are simulations."""
    z = digest_normal(digest(F.lit(seed), F.lit("common"), F.col("id").cast("int")))
    return np.array([r["z"] for r in spark.range(n_sims).select("id", z.alias("z")).orderBy("id").collect()])


def _draws(batch: pa.RecordBatch, shocks: np.ndarray) -> np.ndarray:
    """Engines by simulations."""
    own = batch.column("own").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(shocks))
    spread = batch.column("draw_std").to_numpy(zero_copy_only=False)
    return np.maximum(own + C.COMMON_SHOCK * spread[:, None] * shocks, 0.0)


def _limits(cycles_per_day: float) -> list[tuple[int, float]]:
    return [(d, d * cycles_per_day) for d in C.HORIZON_DAYS]


def engine_failure(fleet: DataFrame, n_sims: int = C.N_SIMULATIONS, seed: int = C.SEED,
                   cycles_per_day: float = C.CYCLES_PER_DAY) -> DataFrame:
    """Failure probability per engine and horizon, counted in the engine's own row."""
    kept = ["subset", "engine_id", "engine_health_status", "predicted_RUL", "subsystem"]
    named = fleet.withColumn("subsystem", subsystem_of(primary_fault(fleet))).select(*kept)
    limits, shocks = _limits(cycles_per_day), _shocks(fleet.sparkSession, n_sims, seed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws = _draws(batch, shocks)
            failed = np.stack([(draws <= limit).sum(axis=1) for _, limit in limits], axis=1)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(failed.tolist(), pa.list_(pa.int64()))], [*kept, "failed"])

    drawn = own_draws(named, n_sims, seed)
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in drawn.select(*kept).schema)
    cells = [F.struct(F.lit(d).alias("horizon_days"), (F.get("failed", F.lit(k)) / F.lit(float(n_sims))).alias("probability"))
             for k, (d, _) in enumerate(limits)]
    return drawn.mapInArrow(count, f"{types}, failed array<bigint>").select(*kept, F.inline(F.array(*cells)))


def simulation_counts(fleet: DataFrame, n_sims: int = C.N_SIMULATIONS, seed: int = C.SEED,
                      cycles_per_day: float = C.CYCLES_PER_DAY) -> DataFrame:
    """Engines down per (subset, horizon, simulation): ``subset, horizon_days, sim, down``.

    A task adds up its engines, so one row per task, subset and horizon is shuffled, whatever the engines and the
    simulations. They are added in two steps, so that no task gets the rows of all tasks.
    """
    limits, shocks = _limits(cycles_per_day), _shocks(fleet.sparkSession, n_sims, seed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        down: dict = {}
        for batch in batches:
            draws, subsets = _draws(batch, shocks), np.array(batch.column("subset").to_pylist(), object)
            for subset in dict.fromkeys(subsets):
                rows = draws[subsets == subset] if subset is not None else draws[[x is None for x in subsets]]
                own = np.stack([(rows <= limit).sum(axis=0) for _, limit in limits])
                down[subset] = down.get(subset, 0) + own
        cells = [(subset, d, own[k]) for subset, own in down.items() for k, (d, _) in enumerate(limits)]
        yield pa.RecordBatch.from_arrays([
            pa.array([c[0] for c in cells], pa.string()), pa.array([c[1] for c in cells], pa.int32()),
            pa.array([c[2].tolist() for c in cells], pa.list_(pa.int64()))], ["subset", "horizon_days", "down"])

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.iloc[:1].assign(down=[sum(np.asarray(d) for d in rows["down"])])

    schema = "subset string, horizon_days int, down array<bigint>"
    drawn = own_draws(fleet.select(*C.UNIT, "predicted_RUL"), n_sims, seed).select("subset", "own", "draw_std")
    counts = drawn.mapInArrow(count, schema).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    some = counts.groupBy("subset", "horizon_days", "part").applyInPandas(
        lambda rows: added(rows)[["subset", "horizon_days", "down"]], schema)
    total = some.groupBy("subset", "horizon_days").applyInPandas(added, schema)
    return total.select("subset", "horizon_days", F.posexplode("down").alias("sim", "down"))


def horizon_summary(counts: DataFrame, capacity: int = C.SHOP_CAPACITY,
                    cycles_per_day: float = C.CYCLES_PER_DAY) -> DataFrame:
    """One row per (subset, horizon); each group holds ``n_sims`` rows."""
    down, n = F.col("down"), F.count(F.lit(1))
    p = F.percentile("down", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))

    def pct(test: Column) -> Column:
        return half_even(F.count_if(test) / n * 100.0, 1)

    return counts.groupBy("subset", "horizon_days").agg(
        pct(down >= 1).alias("probability_any_grounding_pct"), pct(down >= 2).alias("probability_two_or_more_pct"),
        half_even(F.avg(down), 2).alias("expected_groundings"), p.alias("p"),
        pct(down > capacity).alias("probability_over_capacity_pct"),
        half_even(F.avg(F.greatest(down - capacity, F.lit(0))), 2).alias("expected_capacity_shortfall"),
    ).select(
        "subset", "horizon_days", F.rint(F.col("horizon_days") * F.lit(cycles_per_day)).cast("int")
        .alias("horizon_cycles"), "probability_any_grounding_pct", "probability_two_or_more_pct",
        "expected_groundings", F.col("p")[0].cast("int").alias("p50_groundings"),
        F.col("p")[1].cast("int").alias("p90_groundings"), F.col("p")[2].cast("int").alias("worst_case_p99"),
        F.lit(capacity).alias("shop_capacity"), "probability_over_capacity_pct", "expected_capacity_shortfall")


def exceedance(counts: DataFrame) -> DataFrame:
    """P(at least k engines down), k = 1 .. max(10, p99 + 2), as a running count over the observed numbers."""
    cell = ["subset", "horizon_days"]
    tops = counts.groupBy(*cell).agg(F.count(F.lit(1)).alias("sims"), F.percentile("down", 0.99).alias("p99"))
    top = F.greatest(F.lit(10.0), F.col("p99") + 2.0).cast("long")
    grid = tops.select(*cell, "sims", F.explode(F.sequence(F.lit(1).cast("long"), top)).alias("at_least"),
                       F.lit(0).cast("long").alias("n"))
    seen = counts.groupBy(*cell, F.col("down").alias("at_least")).agg(F.count(F.lit(1)).alias("n"))
    down_to = Window.partitionBy(*cell).orderBy(F.col("at_least").desc()).rangeBetween(Window.unboundedPreceding, 0)
    both = grid.unionByName(seen, allowMissingColumns=True).withColumn("reached", F.sum("n").over(down_to))
    return both.filter(F.col("sims").isNotNull()).select(
        *cell, F.col("at_least").cast("int").alias("at_least"),
        half_even(F.col("reached") / F.col("sims") * 100.0, 1).alias("probability_pct"))


def concentration(failure: DataFrame) -> DataFrame:
    """Expected events per subsystem and their share."""
    by = failure.groupBy("subset", "horizon_days", "subsystem").agg(F.sum("probability").alias("events"))
    total = F.sum("events").over(Window.partitionBy("subset", "horizon_days"))  # one row per subsystem name
    return by.withColumn("total", total).filter(F.col("events") > 0.005).select(
        "subset", "horizon_days", "subsystem", half_even(F.col("events"), 2).alias("expected_events"),
        half_even(F.col("events") / F.col("total") * 100.0, 1).alias("share_pct"))


def top_contributors(failure: DataFrame, k: int = 12) -> DataFrame:
    """The k riskiest engines per (subset, horizon); the rank limit is applied before the exchange."""
    order = Window.partitionBy("subset", "horizon_days").orderBy(F.col("failure_probability").desc(), "engine_id")
    return (
        failure.filter(F.col("probability") > 0.01)
        .withColumn("failure_probability", half_even(F.col("probability"), 3))
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("subset", "horizon_days", "rank", "engine_id", engine_code(F.col("engine_id")).alias("engine_code"),
                F.col("engine_health_status").alias("health_status"), "predicted_RUL", "failure_probability",
                "subsystem")
    )
