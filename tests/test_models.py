"""The one-pass scorer against Spark ML, the model store, grouped k-means, and the forest of a small subset."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bladewatch.operators import iforest, regimes, rul, tree_scorer
from bladewatch.operators.tree_scorer import TreeScorer
from bladewatch.sources.model_store import ModelStore, fingerprint

FEATURES = ["a", "b", "c"]
SMALL = {"random_forest": {"numTrees": 7, "maxDepth": 6}, "gradient_boosting": {"maxIter": 6, "maxDepth": 3}}


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(900):
        a, b, c = (float(v) for v in rng.normal(size=3))
        rows.append((("S1", "S2", "S3")[k % 3], k, a, b, c, max(0.0, 40.0 + 9.0 * a - 5.0 * b * (k % 3) + float(rng.normal()))))
    return spark.createDataFrame(rows, "subset string, row int, a double, b double, c double, RUL_capped double").cache()


@pytest.fixture(scope="module", params=list(SMALL))
def fitted(request, spark, frame, tmp_path_factory):
    known = frame.filter("subset <> 'S3'")
    models = {s: rul.fit_rul(known.filter(F.col("subset") == s), request.param, f, **SMALL[request.param])
              for s, f in (("S1", FEATURES), ("S2", ["c", "a"]))}
    path = str(tmp_path_factory.mktemp(request.param))
    rul.write_ensembles(models, spark, path)
    return models, rul.load_scorer(spark, path), path


@pytest.mark.parametrize("max_nodes", [10**9, 1])
def test_scorer_equals_spark_ml(frame, fitted, max_nodes):
    models, scorer, _ = fitted
    want = {r["row"]: r["predicted_RUL"] for r in rul.predict_by_subset(models, frame).select("row", "predicted_RUL").collect()}
    got = {r["row"]: r["predicted_RUL"] for r in scorer.predict(frame, max_nodes=max_nodes).select("row", "predicted_RUL").collect()}
    assert got.keys() == want.keys() and sum(v is None for v in got.values()) == 300
    assert all((got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 1e-9) for k, v in want.items())
    every = {r["row"]: r["predictions"] for r in scorer.predict_all(frame, max_nodes=max_nodes).select("row", "predictions").collect()}
    assert all(v is None or abs(max(every[k].values(), key=lambda x: -abs(x - v)) - v) < 1e-9 for k, v in want.items())
    assert {frozenset(m) for m in every.values()} == {frozenset(("S1", "S2"))}


def test_the_driver_holds_a_part_of_the_trees_at_a_time(spark, frame, fitted, monkeypatch):
    """Whatever the number of trees, no more than one part of them comes to the driver, and predictions are the same."""
    _, whole, path = fitted
    made, flat = [], tree_scorer.flat_trees
    monkeypatch.setattr(tree_scorer, "flat_trees", lambda nodes, *rest: made.append(len(nodes)) or flat(nodes, *rest))
    monkeypatch.setattr(tree_scorer, "PART_NODES", 60)
    scorer = rul.load_scorer(spark, path)
    largest = spark.read.parquet(f"{path}/nodes").groupBy("group", "tree").count().agg(F.max("count")).first()[0]
    assert max(made) <= max(60, largest) and sum(made) == spark.read.parquet(f"{path}/nodes").count()
    assert len(scorer.groups["S1"].parts) > 1 and len(whole.groups["S1"].parts) == 1
    one, two = (x.predict(frame).orderBy("row").toPandas()["predicted_RUL"] for x in (whole, scorer))
    assert np.allclose(one, two, rtol=1e-12, equal_nan=True)
    one, two = ({r["row"]: r["predictions"] for r in x.predict_all(frame).collect()} for x in (whole, scorer))
    assert all(two[k][g] == pytest.approx(v, rel=1e-12) for k, m in one.items() for g, v in m.items())


def test_rows_that_cannot_be_scored(spark, fitted):
    rows = spark.createDataFrame(
        [("S1", 1.0, None, 1.0), ("S2", 1.0, None, 1.0), (None, 1.0, 1.0, 1.0), ("S1", 1.0, 1.0, float("nan"))],
        "subset string, a double, b double, c double")
    got = [r["predicted_RUL"] for r in fitted[1].predict(rows).collect()]
    assert got[0] is None and got[1] is not None and got[2] is None and got[3] is None
    with pytest.raises(ValueError, match="missing feature"):
        fitted[1].predict(rows.drop("c"))
    assert fitted[1].predict(rows.limit(0)).count() == 0


def test_frame_is_read_once(frame, fitted, tmp_path):
    frame.write.parquet(str(tmp_path / "f"))
    rows = frame.sparkSession.read.parquet(str(tmp_path / "f"))
    for scored in (fitted[1].predict(rows), fitted[1].predict_all(rows), rul.transfer_matrix(fitted[1], rows)):
        plan = scored._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") <= 2  # the matrix joins its cells with those of its diagonal


def test_transfer_matrix_equals_scoring_by_each_model(frame, fitted):
    models, scorer, _ = fitted
    got = {(r["source"], r["target"]): (r["rmse"], r["mae"]) for r in rul.transfer_matrix(scorer, frame).collect()}
    for source, model in models.items():
        for target in ("S1", "S2", "S3"):
            rows = rul.predict_rul(model, frame.filter(F.col("subset") == target)).select("RUL_capped", "predicted_RUL").toPandas()
            gap = rows["predicted_RUL"] - rows["RUL_capped"]
            assert got[source, target] == pytest.approx((round(float(np.sqrt((gap**2).mean())), 2), round(float(gap.abs().mean()), 2)), abs=0.011)


def test_importances_are_kept(spark, fitted):
    models, _, path = fitted
    want = {(r["subset"], r["feature"]): r["importance"] for r in rul.feature_importances(models, spark).collect()}
    got = {(r["subset"], r["feature"]): r["importance"] for r in spark.read.parquet(f"{path}/importances").collect()}
    assert got == want and len(rul.top_importances(spark.read.parquet(f"{path}/importances"), 1).collect()) == 2


def test_store_fits_once_and_publishes_last(spark, tmp_path):
    table, fits = str(tmp_path / "in"), []
    spark.range(5).write.parquet(table)

    def fit(path):
        fits.append(path)
        spark.range(len(fits)).write.parquet(path)

    key = fingerprint(spark, [table], depth=3)
    assert ModelStore(spark, str(tmp_path / "m")).find(key) is None
    first = ModelStore(spark, str(tmp_path / "m")).fetch(key, fit)
    assert ModelStore(spark, str(tmp_path / "m")).fetch(key, fit) == first and len(fits) == 1
    assert fingerprint(spark, [table], depth=4) != key and fingerprint(spark, [table], depth=3) == key
    spark.range(1).write.mode("append").parquet(table)
    assert fingerprint(spark, [table], depth=3) != key

    def fails(path):
        spark.range(1).write.parquet(path)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        ModelStore(spark, str(tmp_path / "m")).fetch("other", fails)
    assert ModelStore(spark, str(tmp_path / "m")).find("other") is None
    # two sessions that fit at once publish both, and all readers take the same one
    store = ModelStore(spark, str(tmp_path / "m"))
    inner = []
    outer = store.fetch("both", lambda path: (fit(path), inner.append(store.fetch("both", fit)))[0])
    assert outer == min(fits[-2:]) == store.find("both")


def _settings(spark, subsets, parts=3):
    rng = np.random.default_rng(8)
    centres = {"FD002": [(0, 0), (10, 0), (0, 10)], "FD004": [(5, 5), (50, 5)], "FD005": [(1, 1)]}
    rows = [(s, float(x + rng.normal() * 0.2), float(y + rng.normal() * 0.2), 100.0) for s in subsets
            for x, y in centres[s] for _ in range(60)]
    rows += [(subsets[0], None, 1.0, 100.0)]
    return spark.createDataFrame(rows, "subset string, setting_1 double, setting_2 double, setting_3 double").repartition(parts)


def test_regimes_of_all_subsets_in_one_fit(spark):
    wanted = {"FD002": 3, "FD004": 2, "FD009": 6}
    got = regimes.fit_subset_regimes(_settings(spark, ["FD002", "FD004", "FD005"]), wanted, n_init=4)
    assert {s: len(c) for s, c in got.items()} == {"FD002": 3, "FD004": 2, "FD005": 0}
    assert sorted((round(c[0]), round(c[1])) for c in got["FD002"]) == [(0, 0), (0, 10), (10, 0)]
    assert sorted((round(c[0]), round(c[1])) for c in got["FD004"]) == [(5, 5), (50, 5)]
    again = regimes.fit_subset_regimes(_settings(spark, ["FD002", "FD004", "FD005"], 11), wanted, n_init=4)
    assert all(np.allclose(sorted(got[s]), sorted(again[s])) for s in got)
    placed = regimes.assign_regime(_settings(spark, ["FD002", "FD005"]), got)
    assert {(r["subset"], r["n"]) for r in placed.groupBy("subset").agg(F.countDistinct("_regime").alias("n")).collect()} == {
        ("FD002", 3), ("FD005", 1)}


def test_regimes_without_a_known_or_varied_subset(spark):
    assert regimes.fit_subset_regimes(_settings(spark, ["FD005"])) == {"FD005": []}
    assert regimes.fit_subset_regimes(_settings(spark, ["FD005"]).limit(0)) == {}
    one_point = spark.createDataFrame([("FD002", 1.0, 2.0, 3.0)] * 4, "subset string, setting_1 double, setting_2 double, setting_3 double")
    assert regimes.fit_subset_regimes(one_point) == {"FD002": [[1.0, 2.0, 3.0]]}


def test_small_subset_has_its_own_path_scale(spark):
    rng = np.random.default_rng(4)
    rows = [(s, "train", 1, k, float(rng.normal()), float(rng.normal())) for s, n in (("big", 2_000), ("small", 40)) for k in range(n)]
    df = spark.createDataFrame(rows, "subset string, split string, engine_id int, cycle int, a double, b double")
    both = iforest.fit_forest(df, ["a", "b"], trees=30)
    assert both.drawn == {"big": 256, "small": 40}
    alone = iforest.fit_forest(df.filter("subset = 'small'"), ["a", "b"], trees=30, sample=40)
    one, two = (f.path_score(df.filter("subset = 'small'")).orderBy("cycle").toPandas()["path_score"] for f in (both, alone))
    assert np.allclose(one, two)


def test_a_forest_is_fitted_in_parts_over_few_partitions(spark, frame, tmp_path):
    train = frame.filter("subset = 'S1'").repartition(40)
    fits = rul.fit_parts(train, "random_forest", FEATURES, 300, numTrees=60, maxDepth=4)
    assert len(fits) == 3 and len(rul.fit_parts(train, "gradient_boosting", FEATURES, 300)) == 1
    rul.write_fits({"S1": fits}, spark, str(tmp_path / "m"))
    model = spark.read.parquet(str(tmp_path / "m/models")).first()
    assert model["trees"] == [25, 25, 10] and np.allclose(model["weights"], [1 / 60] * 60)
    loaded = [rul.PipelineModel.load(str(tmp_path / f"m/pipelines/S1/{p}")) for p in range(3)]
    assert len({m.stages[-1].toDebugString.split("\n", 1)[1] for m in loaded}) == 3
    rows = train.withColumn("true_RUL", F.lit(0.0))
    want = sum(n * np.array([r["predicted_RUL"] for r in rul.predict_rul(m, rows).orderBy("row").collect()])
               for m, n in zip(loaded, model["trees"])) / 60
    scorer = rul.load_scorer(spark, str(tmp_path / "m"))
    assert np.allclose([r["predicted_RUL"] for r in scorer.predict(rows).orderBy("row").collect()], want, atol=1e-9)
    weights = [r["importance"] for r in spark.read.parquet(str(tmp_path / "m/importances")).collect()]
    assert len(weights) == 3 and sum(weights) == pytest.approx(1.0)


def test_partitions_of_a_fit_grow_with_its_rows(frame, monkeypatch):
    seen = []
    monkeypatch.setattr(rul, "fit_rul", lambda train, *_, **__: seen.append(train.rdd.getNumPartitions()))
    wide = frame.repartition(40)
    for kind, rows in (("random_forest", 900), ("random_forest", 600_000), ("gradient_boosting", 600_000)):
        rul.fit_parts(wide, kind, FEATURES, rows)[0]()
    assert seen == [1, 2, 3]
