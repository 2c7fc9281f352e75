"""RUL regression with Spark ML and its evaluation."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from bladewatch import constants as C
from bladewatch.functions.accuracy import absolute_error, regression_metrics
from bladewatch.functions.numeric import half_even
from bladewatch.operators import forest
from bladewatch.operators.advisory import add_health_scores
from bladewatch.operators.features import engine_tail
from bladewatch.operators.quality import model_columns, require_columns, selected_features
from bladewatch.operators.tree_scorer import MODELS, NODES, TreeScorer, described, numbered, saved_nodes
from bladewatch.operators.uncertainty import N_FOLDS, fold_of
from bladewatch.sources.stages import materialise

IMPORTANCES = "subset string, feature string, importance double"
FIT_ROWS = {"random_forest": 500_000, "gradient_boosting": 250_000}  # of one partition of a fit
PART_TREES = 25  # of a forest that are fitted together
MOST_FITS = 16  # at once


def regressor(kind: str, **params):
    common = {"featuresCol": "features", "labelCol": "RUL_capped", "seed": C.SEED, "maxMemoryInMB": 256}
    if kind == "random_forest":
        return RandomForestRegressor(**{**common, "featureSubsetStrategy": "all", **C.FOREST_RUL, **params})
    if kind == "gradient_boosting":
        return GBTRegressor(**{**common, "featureSubsetStrategy": "0.8", **C.BOOSTED_RUL, **params})
    raise ValueError(f"unknown model kind {kind!r}")


def fit_rul(train: DataFrame, kind: str = "random_forest", features: list[str] | None = None, **params):
    features = features or [c for c in model_columns(train)]
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    return Pipeline(stages=[assembler, regressor(kind, **params)]).fit(train)


def varying_columns(train: DataFrame) -> dict[str, list[str]]:
    """Per subset found in ``train``: its model columns that vary, in the frame's order."""
    names = model_columns(train)
    chosen = selected_features(train).filter("selected").groupBy("subset").agg(F.collect_set("feature").alias("f")).collect()
    return {r["subset"]: [c for c in names if c in set(r["f"])] for r in sorted(chosen, key=lambda r: r["subset"])}


def fit_parts(train: DataFrame, kind: str, features: list[str], rows: int, **params) -> list[Callable[[], PipelineModel]]:
    """The fits that make one ensemble of ``train``, which has ``rows`` rows; they depend on nothing but the frame.

    The trees of a forest are independent, so its fits have up to PART_TREES of them each and seeds of their own. Rounds of
    boosting follow each other and are one fit. A fit reads few partitions: each of them hands on the sums of every open
    node, feature and bin, however few rows it has.
    """
    few = train.coalesce(max(1, -(-rows // FIT_ROWS[kind])))
    if kind != "random_forest":
        return [lambda: fit_rul(few, kind, features, **params)]
    trees = {**C.FOREST_RUL, **params}["numTrees"]
    return [lambda p=p: fit_rul(few, kind, features, **{
        **params, "numTrees": min(PART_TREES, trees - p * PART_TREES), "seed": C.SEED + p}) for p in range(-(-trees // PART_TREES))]


def subset_fits(train: DataFrame, kind: str, **params) -> dict[str, list]:
    """Per subset found, the fits of its model on the columns that vary there."""
    rows = {r["subset"]: r["count"] for r in train.groupBy("subset").count().collect()}
    return {s: fit_parts(train.filter(F.col("subset") == s), kind, columns, rows[s], **params)
            for s, columns in varying_columns(train).items()}


def inputs_of(model: PipelineModel) -> list[str]:
    return model.stages[0].getInputCols()


def predict_rul(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``predicted_RUL``, never negative."""
    require_columns(df, inputs_of(model))
    out = model.transform(df).withColumn("predicted_RUL", F.greatest(F.col("prediction"), F.lit(0.0)))
    return out.drop("features", "prediction")


def predict_by_subset(models: dict, df: DataFrame) -> DataFrame:
    """Predictions of each subset's own model; rows of a subset without a model keep a NULL."""
    parts = [predict_rul(m, df.filter(F.col("subset") == s)) for s, m in models.items()]
    parts.append(df.filter(~F.col("subset").isin(*models)).withColumn("predicted_RUL", F.lit(None).cast("double")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def evaluate(predicted: DataFrame, group=("subset",), truth: str = "true_RUL") -> DataFrame:
    """Metrics over all cycles and over the last cycle of each engine."""
    slim = predicted.select(*C.UNIT, *[g for g in group if g not in C.UNIT], "cycle", truth, "predicted_RUL")
    every = slim.groupBy(*group).agg(*regression_metrics(F.col(truth), F.col("predicted_RUL")))
    keys = [*C.UNIT, *[g for g in group if g not in C.UNIT]]  # an engine may have a row of each model
    ends_of = F.struct(F.col(truth), half_even(F.col("predicted_RUL"), 2).alias("predicted_RUL"))
    last = slim.groupBy(*keys).agg(F.max_by(ends_of, "cycle").alias("_last")).select(*keys, "_last.*")
    ends = last.groupBy(*group).agg(*regression_metrics(F.col(truth), F.col("predicted_RUL")))
    return every.withColumn("scope", F.lit("all_cycles")).unionByName(ends.withColumn("scope", F.lit("last_cycle")))


def last_cycle_predictions(predicted: DataFrame) -> DataFrame:
    """Prediction table per engine: last cycle, truth, prediction, error, health score and stage."""
    last = engine_tail(predicted.select(*C.UNIT, "cycle", "true_RUL", "predicted_RUL"))
    out = last.withColumn("predicted_RUL", half_even(F.col("predicted_RUL"), 2)).withColumnRenamed(
        "cycle", "last_observed_cycle")
    error = absolute_error(F.col("true_RUL"), F.col("predicted_RUL"))
    return add_health_scores(out.withColumn("absolute_error", error))


def feature_importances(models: dict, spark: SparkSession, top: int | None = None) -> DataFrame:
    """(subset, feature, importance), most important first; as many rows as the models have inputs."""
    rows = [(subset, *weight) for subset, model in models.items() for weight in _importances(model)]
    return top_importances(spark.createDataFrame(rows, IMPORTANCES), top)


def _importances(model: PipelineModel) -> list[tuple[str, float]]:
    return list(zip(inputs_of(model), map(float, model.stages[-1].featureImportances.toArray())))


def _joint_importances(parts: list[list[tuple[str, float]]], trees: list[int]) -> list[tuple[str, float]]:
    """Of a forest in parts: the mean over its trees, again with the sum one."""
    if len(parts) == 1:
        return parts[0]
    total = [sum(n * weight for n, (_, weight) in zip(trees, column)) for column in zip(*parts)]
    return [(name, w / sum(total) if sum(total) > 0 else 0.0) for (name, _), w in zip(parts[0], total)]


def top_importances(weights: DataFrame, top: int | None = None) -> DataFrame:
    order = Window.partitionBy("subset").orderBy(F.col("importance").desc(), "feature")  # rows are bounded by the features
    ranked = weights.withColumn("_rank", F.row_number().over(order))
    return ranked.filter(F.lit(top is None) | (F.col("_rank") <= (top or 0))).drop("_rank").orderBy(
        "subset", F.col("importance").desc(), "feature")


def write_ensembles(models: dict, spark: SparkSession, path: str) -> None:
    """Models of all subsets below ``path``: the pipelines, and what scoring needs as tables."""
    write_fits({s: [lambda m=m: m] for s, m in models.items()}, spark, path)


def write_fits(fits: dict[str, list], spark: SparkSession, path: str) -> None:
    """Runs the fits of all groups and writes their models as ``write_ensembles`` does.

    The independent fits share the cluster. A part is saved as soon as it is fitted, so the driver holds no more models than
    fits run at once.
    """
    def one(job):
        group, part, fit = job
        model = fit()
        model.write().overwrite().save(f"{path}/pipelines/{group}/{part}")
        return group, described(group, model), _importances(model)

    jobs = [(g, p, fit) for g, parts in fits.items() for p, fit in enumerate(parts)]
    with ThreadPoolExecutor(MOST_FITS) as pool:
        done = list(pool.map(one, jobs))
    models, importances = [], []
    for group in fits:
        parts = [(d, i) for g, d, i in done if g == group]
        trees = [len(d[2]) for d, _ in parts]
        weights = [w * (n / sum(trees) if len(parts) > 1 else 1.0) for (d, _), n in zip(parts, trees) for w in d[2]]
        models.append((group, parts[0][0][1], weights, trees))
        importances += [(group, *weight) for weight in _joint_importances([i for _, i in parts], trees)]
    described_models = spark.createDataFrame(models, MODELS)
    flat_nodes(spark, f"{path}/pipelines", described_models).write.parquet(f"{path}/nodes")
    described_models.write.parquet(f"{path}/models")
    spark.createDataFrame(importances, IMPORTANCES).write.parquet(f"{path}/importances")


def subset_rows(train: DataFrame) -> dict[str, tuple[DataFrame, list[str]]]:
    """Per subset found, its rows and the columns that vary there."""
    return {s: (train.filter(F.col("subset") == s), columns) for s, columns in varying_columns(train).items()}


def write_forests(groups: dict[str, tuple[DataFrame, list[str]]], spark: SparkSession, path: str, **params) -> None:
    """Grows a forest for each group of (rows, features) and writes them below ``path``: the trees, and what scoring needs
    as tables. Settings are those of FOREST_RUL but for ``params``."""
    settings = {**C.FOREST_RUL, **params}

    def one(job):
        group, (rows, features) = job
        trees = forest.grow_forest(rows, features, "RUL_capped", seed=C.SEED, **settings)
        trees.write.parquet(f"{path}/trees/{group}")
        return [(group, *w) for w in forest.importances(spark.read.parquet(f"{path}/trees/{group}"), features)]

    with ThreadPoolExecutor(MOST_FITS) as pool:
        weights = [w for found in pool.map(one, groups.items()) for w in found]
    n = settings["numTrees"]
    models = spark.createDataFrame([(g, features, [1.0 / n] * n, [n]) for g, (_, features) in groups.items()], MODELS)
    grown_nodes(spark, f"{path}/trees", models).write.parquet(f"{path}/nodes")
    models.write.parquet(f"{path}/models")
    spark.createDataFrame(weights, IMPORTANCES).write.parquet(f"{path}/importances")


def grown_nodes(spark: SparkSession, path: str, models: DataFrame) -> DataFrame:
    """Node rows of the trees that ``write_forests`` wrote, described by its table of models."""
    out = None
    for r in models.select("group").collect():
        rows = forest.flat(spark.read.schema(forest.TREES).parquet(f"{path}/{r['group']}")).withColumn("group", F.lit(r["group"]))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("group", "tree").applyInPandas(numbered, NODES)


def saved_scorer(spark: SparkSession, path: str, kind: str) -> TreeScorer:
    """The models read from what was saved of them, and not from the store's table of nodes."""
    models = spark.read.parquet(f"{path}/models")
    nodes = grown_nodes(spark, f"{path}/trees", models) if kind == "random_forest" else flat_nodes(spark, f"{path}/pipelines", models)
    return TreeScorer.read(materialise(nodes, "saved-nodes"), models)


def flat_nodes(spark: SparkSession, path: str, models: DataFrame) -> DataFrame:
    """Node rows of the pipelines that ``write_ensembles`` wrote, described by its table of models."""
    out = None
    for r in models.select("group", "trees").collect():
        for part in range(len(r["trees"])):
            rows = saved_nodes(spark, f"{path}/{r['group']}/{part}", r["group"], sum(r["trees"][:part]))
            out = rows if out is None else out.unionByName(rows)
    return out


def load_scorer(spark: SparkSession, path: str) -> TreeScorer:
    return TreeScorer.read(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/models"))


def _fold(subset: str, fold: int) -> str:
    return f"{subset}/{fold}"


def write_cross_fitted(train: DataFrame, spark: SparkSession, path: str, kind: str, folds: int = N_FOLDS, **params) -> None:
    """One model for each subset and fold, fitted on the engines of the other folds; a subset whose engines are all in one
    fold has none."""
    marked = train.withColumn("_fold", fold_of(F.col("engine_id"), folds))
    found = {(r["subset"], r["_fold"]): r["count"] for r in marked.groupBy("subset", "_fold").count().collect()}
    columns = varying_columns(train)

    def rows_of(subset, fold):
        return marked.filter((F.col("subset") == subset) & (F.col("_fold") != fold)).drop("_fold")

    def cell(subset, fold):
        rows = rows_of(subset, fold)
        return fit_parts(rows, kind, columns[subset], sum(n for (s, f), n in found.items() if s == subset and f != fold), **params)

    cells = sorted(c for c in found if any(s == c[0] and f != c[1] for s, f in found))
    if cells and kind == "random_forest":
        write_forests({_fold(s, f): (rows_of(s, f), columns[s]) for s, f in cells}, spark, path, **params)
    elif cells:
        write_fits({_fold(*c): cell(*c) for c in cells}, spark, path)
    else:
        spark.createDataFrame([], NODES).write.parquet(f"{path}/nodes")
        spark.createDataFrame([], MODELS).write.parquet(f"{path}/models")


def predict_out_of_fold(scorer: TreeScorer, train: DataFrame, folds: int = N_FOLDS) -> DataFrame:
    """Adds the prediction of the model that never saw the row's engine, of all subsets and folds in one pass."""
    cell = F.concat_ws("/", "subset", fold_of(F.col("engine_id"), folds).cast("string"))
    return scorer.predict(train.withColumn("_cell", cell), group_col="_cell").drop("_cell")


def transfer_matrix(scorer: TreeScorer, test: DataFrame) -> DataFrame:
    """RMSE and MAE of each source model on each target subset, with the penalty against its own subset.

    The frame is read once: every row gets all sources' predictions.
    """
    scored = scorer.predict_all(test.select("subset", "RUL_capped", *scorer.features)).select(
        F.col("subset").alias("target"), "RUL_capped", F.explode("predictions").alias("source", "predicted_RUL"))
    err = F.col("predicted_RUL") - F.col("RUL_capped")
    cells = scored.groupBy("source", "target").agg(
        F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"))
    return transfer_penalties(cells)


def transfer_penalties(cells: DataFrame) -> DataFrame:
    own = cells.filter(F.col("source") == F.col("target")).select("source", F.col("rmse").alias("own_rmse"))
    joined = cells.join(own, "source", "left")
    return joined.select(
        "source", "target", (F.col("source") == F.col("target")).alias("in_domain"),
        half_even(F.col("rmse"), 2).alias("rmse"), half_even(F.col("mae"), 2).alias("mae"),
        half_even((F.col("rmse") / F.col("own_rmse") - 1.0) * 100.0, 1).alias("transfer_penalty_pct"))


def transfer_summary(matrix: DataFrame) -> DataFrame:
    inside = F.avg(F.when(F.col("in_domain"), F.col("rmse")))
    outside = F.avg(F.when(~F.col("in_domain"), F.col("rmse")))
    return matrix.agg(
        half_even(inside, 2).alias("mean_in_domain_rmse"), half_even(outside, 2).alias("mean_transfer_rmse"),
        half_even((F.try_divide(outside, inside) - 1.0) * 100.0, 1).alias("transfer_degradation_pct"))


def maintenance_classification(predicted: DataFrame, threshold: float, group=("subset",)) -> DataFrame:
    """Accuracy, precision, recall and F1 of the label RUL < threshold, in one aggregate."""
    truth, guess = F.col("true_RUL") < threshold, F.col("predicted_RUL") < threshold
    counts = predicted.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(truth & guess).alias("tp"), F.count_if(~truth & guess).alias("fp"),
        F.count_if(truth & ~guess).alias("fn"), F.count_if(~truth & ~guess).alias("tn"))
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * F.col("tp"), F.lit(2) * F.col("tp") + F.col("fp") + F.col("fn")),
                    F.lit(0.0))
    return counts.withColumns({
        "accuracy_pct": half_even((F.col("tp") + F.col("tn")) / F.col("n") * 100.0, 2),
        "precision_pct": half_even(precision * 100.0, 2), "recall_pct": half_even(recall * 100.0, 2),
        "f1_pct": half_even(f1 * 100.0, 2)})
