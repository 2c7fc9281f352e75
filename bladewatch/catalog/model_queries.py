"""Queries over fitted models. SQL states what must hold of them whatever trees were grown."""

from __future__ import annotations

from pyspark.sql import functions as F

from bladewatch import constants as C
from bladewatch.catalog.inputs import test_rows, train_rows
from bladewatch.catalog.sql_base import with_ctes
from bladewatch.functions.numeric import half_even
from bladewatch.operators import advisory, explain, features, iforest, plotdata, regimes, rul, uncertainty
from bladewatch.operators.components import fit_components
from bladewatch.operators.forest import MAX_BINS
from bladewatch.operators.stats import baseline_moments
from bladewatch.session import scratch_path
from bladewatch.sources.model_store import ModelStore, fingerprint
from bladewatch.sources.stages import materialise
from bladewatch.sources.supplied import hot_units, labelled, table

QUERIES, SQL = {}, {}

INPUTS = ("lineitem", "orders", "part", "supplier")  # what the telemetry view reads

_kept: dict = {}


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def _key(spark, sf_dir, **settings):
    return fingerprint(spark, [f"{sf_dir}/{t}.parquet" for t in INPUTS], **settings)


def _once(spark, sf_dir, what, make):
    """``make()`` once per session and state of the input files."""
    key = (spark.sparkContext.applicationId, what, _key(spark, sf_dir))
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def _normaliser(spark, sf_dir, lab):
    """Regime centres and statistics of every subset, from the store."""
    def fit(path):
        centres = regimes.fit_subset_regimes(train_rows(lab))
        regimes.Normaliser.fit(train_rows(lab), centres).save(spark, path)

    key = _key(spark, sf_dir, model="normaliser", regimes=C.SUBSET_REGIMES, seed=C.SEED, columns=lab.columns)
    return regimes.Normaliser.load(spark, ModelStore(spark).fetch(key, fit))


def _staged(spark, sf_dir, with_features=True):
    """The labels with their regimes, or those with z-scores and rolling features as well.

    Labels are a stage table and a regime is worked out of a row, so only features are written, once and when asked for;
    the fits pass over them many times.
    """
    if not with_features:
        return _placed(spark, sf_dir)[0]
    return _once(spark, sf_dir, "features", lambda: materialise(_rolled(spark, sf_dir, lambda rows: rows), "features"))


def _placed(spark, sf_dir):
    lab = labelled(spark, sf_dir)
    normaliser = _once(spark, sf_dir, "normaliser", lambda: _normaliser(spark, sf_dir, lab))
    return regimes.assign_regime(lab, normaliser.centres), normaliser


def _rolled(spark, sf_dir, chosen):
    """Z-scores and rolling features of the chosen engines' rows."""
    placed, normaliser = _placed(spark, sf_dir)
    scaled = regimes.normalise(chosen(placed), normaliser.statistics)
    return features.engineer_features(scaled, split_hot=hot_units(spark, sf_dir))


def _features(spark, sf_dir, chosen=lambda rows: rows):
    """The chosen engines' rows of the staged features; worked out at every pass, and not written, if this session has no such
    table.

    They have several times the columns of the labels, in whose table engines lie together, so a few passes move less.
    """
    if (spark.sparkContext.applicationId, "features", _key(spark, sf_dir)) in _kept:
        return chosen(_staged(spark, sf_dir))
    return _rolled(spark, sf_dir, chosen)


@register("m1_operating_regimes", f"""
SELECT subset, split, count(*) AS cycles, CAST(0 AS BIGINT) AS not_nearest,
  CASE WHEN subset IN ('FD002', 'FD004') THEN 6 ELSE 1 END AS regimes FROM lab GROUP BY ALL""")
def m1_operating_regimes(spark, sf_dir):
    """Cycles per frame, those not with their nearest centre (none), and the number of regimes met in training."""
    placed = _staged(spark, sf_dir, with_features=False)
    settings = [c for c in C.SETTINGS if c in placed.columns]
    centres = train_rows(placed).groupBy("subset", "_regime").agg(*[F.avg(c).alias(c) for c in settings]).groupBy(
        "subset").agg(F.collect_list(F.struct("_regime", *settings)).alias("_centres"))  # as many as there are regimes
    gap = lambda c: sum((c[s] - F.col(s)) ** 2 for s in settings)
    own = F.filter("_centres", lambda c: c["_regime"] == F.col("_regime"))[0]
    near = placed.join(F.broadcast(centres), "subset")
    return near.groupBy("subset", "split").agg(
        F.count(F.lit(1)).alias("cycles"),
        F.count_if(gap(own) > F.array_min(F.transform("_centres", gap)) + 1e-6).alias("not_nearest"),
        F.max(F.size("_centres")).alias("regimes"))


def _model_path(spark, sf_dir, kind):
    """Full-size models of every subset: from the store, or fitted and published there."""
    frame = _staged(spark, sf_dir)

    def fit(path):
        if kind == "random_forest":
            rul.write_forests(rul.subset_rows(train_rows(frame)), spark, path)
        else:
            rul.write_fits(rul.subset_fits(train_rows(frame), kind), spark, path)

    key = _key(spark, sf_dir, model=kind, columns=frame.columns, seed=C.SEED, **(
        {"bins": MAX_BINS, "parameters": C.FOREST_RUL} if kind == "random_forest" else
        {"parts": rul.PART_TREES, "parameters": C.BOOSTED_RUL}))
    return ModelStore(spark).fetch(key, fit)


def _scorer(spark, sf_dir, kind):
    """The models of ``kind`` as flat trees, read once a session."""
    return _once(spark, sf_dir, kind, lambda: rul.load_scorer(spark, _model_path(spark, sf_dir, kind)))


def _frame(spark, sf_dir):
    return _staged(spark, sf_dir).withColumn("true_RUL", F.col("RUL_capped").cast("double"))


def _predicted(spark, sf_dir, rows):
    """Rows with a prediction of each kind of model, in one pass."""
    for kind in KINDS:
        rows = _scorer(spark, sf_dir, kind).predict(rows, out=kind)
    return rows


def _by_kind(predicted):
    """One row per model kind and row of ``predicted``: (model, predicted_RUL, and the other columns)."""
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("model"), F.col(k).alias("predicted_RUL")) for k in KINDS)))
    return predicted.select("*", kinds.alias("_k")).select(
        "_k.model", "_k.predicted_RUL", *[c for c in predicted.columns if c not in KINDS])


KINDS = ("random_forest", "gradient_boosting")


@register("m4_random_forest_rul")
def m4_random_forest_rul(spark, sf_dir):
    return rul.last_cycle_predictions(_scorer(spark, sf_dir, "random_forest").predict(test_rows(_frame(spark, sf_dir))))


@register("m4_boosted_rul")
def m4_boosted_rul(spark, sf_dir):
    return rul.last_cycle_predictions(_scorer(spark, sf_dir, "gradient_boosting").predict(test_rows(_frame(spark, sf_dir))))


@register("m4_model_checks", " UNION ALL ".join(
    f"SELECT '{k}' AS model, subset, count(*) AS n, CAST(0 AS BIGINT) AS negative, true AS beats_the_mean FROM lab "
    f"WHERE split = 'train' GROUP BY ALL" for k in KINDS))
def m4_model_checks(spark, sf_dir):
    """On the training rows: no prediction is negative, and each model has a lower error than the mean label."""
    slim = _predicted(spark, sf_dir, train_rows(_frame(spark, sf_dir))).select("subset", "true_RUL", *KINDS)
    error = F.col("predicted_RUL") - F.col("true_RUL")
    return _by_kind(slim).groupBy("model", "subset").agg(
        F.count("predicted_RUL").alias("n"), F.count_if(F.col("predicted_RUL") < 0).alias("negative"),
        (F.avg(error * error) < F.var_pop("true_RUL")).alias("beats_the_mean"))


@register("s7_saved_rul", " UNION ALL ".join(
    f"SELECT '{k}' AS model, subset, count(*) AS rows, 0e0 AS difference FROM lab WHERE split = 'test' GROUP BY ALL"
    for k in KINDS))
def s7_saved_rul(spark, sf_dir):
    """Saved models loaded again and the store's tables give equal predictions; ``difference`` is the largest change."""
    rows = _predicted(spark, sf_dir, test_rows(_frame(spark, sf_dir)))
    for kind in KINDS:
        loaded = rul.saved_scorer(spark, _model_path(spark, sf_dir, kind), kind)
        rows = loaded.predict(rows, out=f"{kind}_loaded")
    gaps = [F.struct(F.lit(k).alias("model"), F.abs(F.col(k) - F.col(f"{k}_loaded")).alias("gap")) for k in KINDS]
    return rows.select("subset", F.inline(F.array(*gaps))).groupBy("model", "subset").agg(
        F.count("gap").alias("rows"), F.max("gap").alias("difference"))


@register("a21_training_summary")
def a21_training_summary(spark, sf_dir):
    slim = _predicted(spark, sf_dir, test_rows(_frame(spark, sf_dir))).select(*C.UNIT, "cycle", "true_RUL", *KINDS)
    return rul.evaluate(_by_kind(slim), group=("model", "subset"))


@register("a21_summary_checks", " UNION ALL ".join(
    f"SELECT '{k}' AS model, subset, '{scope}' AS scope, true AS spread_holds, true AS better_than_nothing FROM lab "
    f"WHERE split = 'test' GROUP BY ALL" for k in KINDS for scope in ("all_cycles", "last_cycle")))
def a21_summary_checks(spark, sf_dir):
    """A row for each model, subset and scope; no mean error is above the root of the mean squared one, no R2 above 1."""
    return a21_training_summary(spark, sf_dir).select(
        "model", "subset", "scope", (F.col("mae") <= F.col("rmse") + 1e-9).alias("spread_holds"),
        ((F.col("r2") <= 1.0) & (F.col("mae") >= 0.0)).alias("better_than_nothing"))


@register("o2_feature_importances")
def o2_feature_importances(spark, sf_dir):
    parts = [rul.top_importances(spark.read.parquet(f"{_model_path(spark, sf_dir, k)}/importances"), 15).withColumn(
        "model", F.lit(k)) for k in KINDS]
    return parts[0].unionByName(parts[1])


@register("o2_importance_checks", " UNION ALL ".join(
    f"SELECT DISTINCT '{k}' AS model, subset, CAST(0 AS BIGINT) AS negative, true AS sum_to_one FROM lab WHERE split = 'train'"
    for k in KINDS))
def o2_importance_checks(spark, sf_dir):
    """The importances of every model: none is negative, and they sum to one."""
    parts = [spark.read.parquet(f"{_model_path(spark, sf_dir, k)}/importances").withColumn("model", F.lit(k)) for k in KINDS]
    return parts[0].unionByName(parts[1]).groupBy("model", "subset").agg(
        F.count_if(F.col("importance") < 0).alias("negative"), (F.abs(F.sum("importance") - 1.0) < 1e-9).alias("sum_to_one"))


@register("a20_transfer_matrix")
def a20_transfer_matrix(spark, sf_dir):
    return rul.transfer_matrix(_scorer(spark, sf_dir, "random_forest"), test_rows(_frame(spark, sf_dir)))


@register("a20_matrix_checks", """
SELECT a.subset AS source, b.subset AS target, a.subset = b.subset AS in_domain, true AS spread_holds, true AS own_penalty_is_zero
FROM (SELECT DISTINCT subset FROM lab WHERE split = 'train') a, (SELECT DISTINCT subset FROM lab WHERE split = 'test') b""")
def a20_matrix_checks(spark, sf_dir):
    """Every pair of a trained and a tested subset once, without penalty on the own subset."""
    penalty = F.col("transfer_penalty_pct")
    return a20_transfer_matrix(spark, sf_dir).select(
        "source", "target", "in_domain", (F.col("mae") <= F.col("rmse")).alias("spread_holds"),
        F.when(F.col("in_domain"), penalty == 0.0).otherwise(penalty.isNotNull()).alias("own_penalty_is_zero"))


@register("a20_transfer_summary")
def a20_transfer_summary(spark, sf_dir):
    return rul.transfer_summary(a20_transfer_matrix(spark, sf_dir))


FOLD_FOREST = {"numTrees": 20, "maxDepth": 8, "minInstancesPerNode": 2}  # of the models that are fitted per fold


def _out_of_fold(spark, sf_dir):
    """Training rows with the prediction of a forest fitted on the engines of the other folds."""
    frame = train_rows(_staged(spark, sf_dir))

    def fit(path):
        rul.write_cross_fitted(frame, spark, path, "random_forest", **FOLD_FOREST)

    key = _key(spark, sf_dir, model="cross_fitted", columns=frame.columns, seed=C.SEED, parameters=FOLD_FOREST,
               bins=MAX_BINS, folds=uncertainty.N_FOLDS)
    scorer = rul.load_scorer(spark, ModelStore(spark).fetch(key, fit))
    return rul.predict_out_of_fold(scorer, frame).select(
        *C.UNIT, "cycle", F.col("RUL_capped").cast("double").alias("true_RUL"), half_even(F.col("predicted_RUL"), 2).alias("predicted_RUL"))


@register("a17_cross_fitted_calibration")
def a17_cross_fitted_calibration(spark, sf_dir):
    """Coverage of the test rows' intervals by the offsets of out-of-fold residuals; predictions by the full-size forest."""
    held = _out_of_fold(spark, sf_dir)
    offsets = _model_offsets(held)
    rows = _scorer(spark, sf_dir, "random_forest").predict(test_rows(_frame(spark, sf_dir))).select(
        "subset", "true_RUL", half_even(F.col("predicted_RUL"), 2).alias("predicted_RUL"))
    return uncertainty.calibration(rows, offsets)


def _model_offsets(held):
    residuals = held.filter("predicted_RUL IS NOT NULL").withColumn(
        "residual", half_even(F.col("true_RUL") - F.col("predicted_RUL"), 2))
    return uncertainty.complete_offsets(uncertainty.fit_offsets(residuals), held)


@register("a18_cross_fitted_checks", f"""
SELECT subset, a.alpha, count(*) AS n, true AS covers, true AS every_row_held_out FROM lab,
  (VALUES {', '.join(f'({a}e0)' for a in C.ALPHAS)}) a(alpha) WHERE split = 'train' GROUP BY ALL""")
def a18_cross_fitted_checks(spark, sf_dir):
    """On the rows whose residuals gave the offsets: each is predicted by models that never saw its engine, and the
    intervals cover at least their nominal share."""
    held = _out_of_fold(spark, sf_dir)
    rows = uncertainty.add_interval(uncertainty.every_alpha(held), _model_offsets(held))
    inside = (F.col("true_RUL") >= F.col("lower") - 0.005) & (F.col("true_RUL") <= F.col("upper") + 0.005)
    return rows.groupBy("subset", "alpha").agg(
        F.count(F.lit(1)).alias("n"),
        (F.count_if(inside) / F.count(F.lit(1)) >= 1.0 - F.first("alpha") - 0.02).alias("covers"),
        (F.count("predicted_RUL") == F.count(F.lit(1))).alias("every_row_held_out"))


def _forest(spark, sf_dir):
    frame = _features(spark, sf_dir)

    def fit(path):
        train = _features(spark, sf_dir, train_rows)
        names = {c for columns in rul.varying_columns(train).values() for c in columns}
        iforest.fit_forest(train, [c for c in frame.columns if c in names]).save(spark, path)

    def load():
        key = _key(spark, sf_dir, model="isolation_forest", columns=frame.columns, seed=C.SEED, parameters=[
            C.FOREST_TREES, C.FOREST_SAMPLE, C.FOREST_CONTAMINATION])
        return iforest.IsolationForest.load(spark, ModelStore(spark).fetch(key, fit))

    return _once(spark, sf_dir, "isolation_forest", load), frame


@register("m5_isolation_forest")
def m5_isolation_forest(spark, sf_dir):
    forest, frame = _forest(spark, sf_dir)
    return forest.score(frame).select(
        *C.UNIT, "cycle", "anomaly_raw_score", "anomaly_score", "anomaly_vote", "anomaly_label", "anomaly_severity")


@register("s7_saved_forest", "SELECT subset, count(*) AS rows, 0e0 AS difference FROM lab GROUP BY ALL")
def s7_saved_forest(spark, sf_dir):
    """A forest saved and loaded again; ``difference`` is the largest score change and must be zero."""
    forest, frame = _forest(spark, sf_dir)
    path = scratch_path(spark, "forest")
    forest.save(spark, path)
    loaded = iforest.IsolationForest.load(spark, path)
    slim = frame.dropna(subset=[*C.UNIT, "cycle"]).select("subset", *forest.features)
    one = forest.score(slim).select("subset", *forest.features, F.col("anomaly_score").alias("before"))
    both = loaded.score(one).withColumnRenamed("anomaly_score", "after")  # in the row itself, so nothing is joined
    return both.groupBy("subset").agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.abs(F.col("before") - F.col("after"))).alias("difference"))


@register("advisory_from_models")
def advisory_from_models(spark, sf_dir):
    """The whole chain on fitted models: RUL forest and isolation forest to the fleet advisory."""
    predicted = _scorer(spark, sf_dir, "random_forest").predict(test_rows(_frame(spark, sf_dir)))
    forest, frame = _forest(spark, sf_dir)
    explained = explain.explain(forest.score(predicted), baseline_moments(train_rows(frame)))
    return advisory.fleet_advisory(explained)


@register("m5_forest_checks", """
SELECT subset, split, count(*) AS cycles, CAST(0 AS BIGINT) AS outside, true AS vote_share_holds FROM lab
WHERE split = 'train' GROUP BY ALL""")
def m5_forest_checks(spark, sf_dir):
    """On the training rows: scores lie in 0..100 and the share of votes against comes near the contamination."""
    forest, _ = _forest(spark, sf_dir)
    return forest.score(_features(spark, sf_dir, train_rows)).groupBy("subset", "split").agg(
        F.count(F.lit(1)).alias("cycles"), F.count_if(~F.col("anomaly_score").between(0.0, 100.0)).alias("outside"),
        (F.abs(F.avg((F.col("anomaly_vote") == -1).cast("double")) - C.FOREST_CONTAMINATION) < 0.02).alias("vote_share_holds"))


def _feature_columns(frame):
    ids = {*C.UNIT, "cycle", "_regime", "RUL", "RUL_capped"}
    return [f.name for f in frame.schema if f.name not in ids and f.dataType.simpleString() in ("double", "float", "int", "bigint")]


@register("m7_subset_components")
def m7_subset_components(spark, sf_dir):
    """Every test row in the first two components of its subset's features, with their shares of the variance."""
    frame = _features(spark, sf_dir, test_rows)
    fitted = fit_components(frame, _feature_columns(frame))
    shares = spark.createDataFrame(
        [(s, *(round(float(x), 6) for x in fitted.shares(s))) for s in fitted.axes], "subset string, explained_1 double, explained_2 double")
    rows = fitted.project(frame).select(*C.UNIT, "cycle", *(half_even(F.col(c), 4).alias(c) for c in ("pc_1", "pc_2")))
    return rows.join(F.broadcast(shares), "subset")


@register("m7_subset_checks", """
SELECT subset, count(*) AS cycles, true AS centred, true AS uncorrelated, true AS first_is_largest, true AS shares_hold
FROM lab WHERE split = 'test' GROUP BY ALL""")
def m7_subset_checks(spark, sf_dir):
    """Components of each subset: centred, uncorrelated, and their variances have the said shares in that of all features."""
    frame = _features(spark, sf_dir, test_rows)
    columns = _feature_columns(frame)
    fitted = fit_components(frame, columns)
    a, b = F.col("pc_1"), F.col("pc_2")
    spread = sum(F.var_samp(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in columns)
    wide = fitted.project(frame).groupBy("subset").agg(
        F.count(F.lit(1)).alias("cycles"), F.avg(a).alias("m1"), F.avg(b).alias("m2"), F.var_samp(a).alias("v1"),
        F.var_samp(b).alias("v2"), F.covar_samp(a, b).alias("c"), spread.alias("total"))
    shares = spark.createDataFrame(
        [(s, *(float(x) for x in fitted.shares(s))) for s in fitted.axes], "subset string, e1 double, e2 double")
    size = F.sqrt("total")
    return wide.join(F.broadcast(shares), "subset").select(
        "subset", "cycles", ((F.abs("m1") + F.abs("m2")) / size < 1e-9).alias("centred"),
        (F.abs("c") / F.col("total") < 1e-9).alias("uncorrelated"), (F.col("v1") >= F.col("v2")).alias("first_is_largest"),
        ((F.abs(F.col("v1") / F.col("total") - F.col("e1")) < 1e-9)
         & (F.abs(F.col("v2") / F.col("total") - F.col("e2")) < 1e-9)).alias("shares_hold"))


def _components(spark, sf_dir):
    """Projection of the embeddings; a vector of another length than the others is an error."""
    vectors = table(spark, sf_dir, "embeddings")
    width = vectors.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if width[0] != width[1]:
        raise ValueError(f"vectors have between {width[0]} and {width[1]} components")
    return plotdata.principal_components(*plotdata.array_columns(vectors, "embedding", width[0]))


@register("m7_principal_components")
def m7_principal_components(spark, sf_dir):
    projected, shares = _components(spark, sf_dir)
    return projected.select("vec_id", "label", half_even(F.col("pc_1"), 6).alias("pc_1"),
                            half_even(F.col("pc_2"), 6).alias("pc_2"),
                            *[F.lit(round(s, 6)).alias(f"explained_{i + 1}") for i, s in enumerate(shares)])


@register("m7_component_checks", """
SELECT count(*) AS vectors, true AS centred, true AS uncorrelated, true AS first_is_largest FROM embeddings""")
def m7_component_checks(spark, sf_dir):
    projected, _ = _components(spark, sf_dir)
    a, b = F.col("pc_1"), F.col("pc_2")
    return projected.agg(
        F.count(F.lit(1)).alias("vectors"),
        ((F.abs(F.avg(a)) < 1e-6) & (F.abs(F.avg(b)) < 1e-6)).alias("centred"),
        (F.abs(F.corr(a, b)) < 1e-6).alias("uncorrelated"), (F.var_pop(a) >= F.var_pop(b)).alias("first_is_largest"))


@register("s7_saved_regimes", "SELECT subset, split, count(*) AS rows, 0e0 AS difference FROM lab GROUP BY ALL")
def s7_saved_regimes(spark, sf_dir):
    """Rows normalised by the fitted regimes before they were saved and after; ``difference`` is the largest change."""
    lab = labelled(spark, sf_dir)
    fitted, path = regimes.Normaliser.fit(train_rows(lab)), scratch_path(spark, "normaliser")
    fitted.save(spark, path)
    loaded = regimes.Normaliser.load(spark, path)
    sensors = [c for c in C.SENSORS if c in lab.columns]
    rows = lab.dropna(subset=[*C.UNIT, "cycle"]).withColumns({f"_raw_{s}": F.col(s) for s in sensors})
    one = fitted.transform(rows).withColumn("before", F.array("_regime", *sensors)).withColumns(
        {s: F.col(f"_raw_{s}") for s in sensors})
    both = loaded.transform(one.drop("_regime")).withColumn("after", F.array("_regime", *sensors))  # nothing is joined
    gap = F.array_max(F.zip_with("before", "after", lambda a, b: F.abs(a - b)))
    return both.groupBy("subset", "split").agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.coalesce(gap, F.lit(0.0))).alias("difference"))


SQL = {name: with_ctes(sql, "lab") if "FROM lab" in sql else sql for name, sql in SQL.items()}
