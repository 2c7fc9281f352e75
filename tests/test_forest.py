"""Forests grown over binned rows: splits against brute force, upper levels against whole trees, saved models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bladewatch.operators import forest, rul
from bladewatch.session import tune

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(900):
        a, b, c = float(rng.normal()), float(rng.normal()), float(k % 4)
        rows.append((("S1", "S2")[k % 2], k, a, b, c, round(max(0.0, 40.0 + 9.0 * a - 5.0 * b * c + float(rng.normal())))))
    return tune(spark).createDataFrame(rows, "subset string, row int, a double, b double, c double, RUL_capped long").repartition(3).cache()


def _trees(rows, **params):
    grown = forest.grow_forest(rows, FEATURES, "RUL_capped", numTrees=5, maxDepth=6, minInstancesPerNode=2, seed=3, **params).toPandas()
    return grown.sort_values(["tree", "node"]).reset_index(drop=True)


def test_a_tree_takes_the_splits_of_brute_force():
    rng = np.random.default_rng(6)
    bins, labels, draws = rng.integers(0, 7, (3, 60)).astype(np.uint8), rng.normal(size=60), rng.integers(1, 3, 60).astype(float)

    def error(rows):
        return (draws[rows] * (labels[rows] - np.average(labels[rows], weights=draws[rows])) ** 2).sum()

    def walk(node, rows, depth):
        found = {node: np.average(labels[rows], weights=draws[rows])}
        cuts = [(error(rows) - error(rows & (bins[f] <= b)) - error(rows & (bins[f] > b)), f, b) for f in range(3) for b in range(7)
                if min(draws[rows & (bins[f] <= b)].sum(), draws[rows & (bins[f] > b)].sum()) >= 4]
        if depth and cuts and max(cuts)[0] > 1e-9:
            _, f, b = max(cuts)
            found |= walk(2 * node, rows & (bins[f] <= b), depth - 1) | walk(2 * node + 1, rows & (bins[f] > b), depth - 1)
        return found

    got = forest.grow(bins, labels, draws, 1, 4, 4)
    want = walk(1, np.ones(60, bool), 4)
    assert got["node"].is_unique and dict(zip(got["node"], got["value"])) == pytest.approx(want)


def test_upper_levels_and_dealt_nodes_make_the_same_trees(frame):
    whole, split = _trees(frame), _trees(frame, cell_rows=60)
    assert split["node"].max() > 15 and set(whole["tree"]) == set(range(5))
    assert whole.drop(columns=["gain", "value"]).equals(split.drop(columns=["gain", "value"]))
    assert np.allclose(whole[["gain", "value"]], split[["gain", "value"]])


def test_saved_forests_predict_as_their_scorer(spark, frame, tmp_path):
    path, known = str(tmp_path / "m"), frame.filter("subset = 'S1'")
    tiny = frame.filter("subset = 'S2'").limit(1)
    rul.write_forests({"S1": (known, FEATURES), "S2": (tiny, ["a"])}, spark, path, numTrees=30, maxDepth=7)
    models = {r["group"]: r for r in spark.read.parquet(f"{path}/models").collect()}
    assert models["S1"]["trees"] == [30] and np.allclose(models["S2"]["weights"], [1 / 30] * 30)
    scorers = rul.load_scorer(spark, path), rul.saved_scorer(spark, path, "random_forest")
    assert all(len(s.groups["S2"].roots) == 30 for s in scorers)  # also the trees that drew no row
    one, two = (s.predict(frame.select("row", "subset", *FEATURES, "RUL_capped")).orderBy("row").toPandas() for s in scorers)
    assert one["predicted_RUL"].equals(two["predicted_RUL"])
    own, lone = one[one["subset"] == "S1"], one[one["subset"] == "S2"]
    assert lone["predicted_RUL"].to_numpy() == pytest.approx(tiny.first()["RUL_capped"])
    assert ((own["predicted_RUL"] - own["RUL_capped"]) ** 2).mean() < 0.1 * own["RUL_capped"].var()
    weights = {(r["subset"], r["feature"]): r["importance"] for r in spark.read.parquet(f"{path}/importances").collect()}
    assert sum(w for (s, _), w in weights.items() if s == "S1") == pytest.approx(1.0) and min(weights.values()) >= 0.0


def test_rows_with_unknown_features_are_refused(frame):
    with pytest.raises(ValueError, match="without a label or a feature"):
        _trees(frame.withColumn("b", F.when(F.col("row") != 7, F.col("b"))))


def test_features_of_few_values_keep_all_of_them(frame):
    edges, rows, _ = forest.bin_edges(frame, FEATURES, "RUL_capped")
    assert rows == 900 and edges[2].tolist() == [0.0, 1.0, 2.0] and len(edges[0]) == forest.MAX_BINS - 1


def test_cross_fitted_forests_are_grown_the_same_way(spark, frame, tmp_path):
    path, rows = str(tmp_path / "x"), frame.withColumn("engine_id", (F.col("row") % 9).cast("long")).withColumn("split", F.lit("train"))
    named = rows.select("subset", "split", "engine_id", F.col("row").alias("cycle"), F.col("a").alias("sensor_2"),
                        F.col("b").alias("sensor_3"), F.col("c").alias("sensor_4"), "RUL_capped")
    rul.write_cross_fitted(named, spark, path, "random_forest", numTrees=4, maxDepth=4)
    held = rul.predict_out_of_fold(rul.load_scorer(spark, path), named)
    assert held.filter("predicted_RUL IS NULL").count() == 0 and spark.read.parquet(f"{path}/models").count() > 2
