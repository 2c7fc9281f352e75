"""Inputs that read and write no more than a query needs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bladewatch.catalog import all_queries, data_queries, model_queries
from bladewatch.operators.components import fit_components
from bladewatch.session import tune
from bladewatch.sources import stages, supplied, text


@pytest.fixture
def tables(spark, sf, tmp_path):
    """Own copies of the tables, of which no stage has been written; ``twice`` names those whose rows come twice."""
    def copy(*twice):
        for name in supplied.INPUTS:
            rows = spark.read.parquet(f"{sf}/{name}.parquet")
            (rows.unionByName(rows) if name in twice else rows).write.parquet(f"{tmp_path}/{'-'.join(twice)}/{name}.parquet")
        return f"{tmp_path}/{'-'.join(twice)}"
    return copy


def test_rolling_settings_read_the_line_items_alone(spark, tables):
    path = tables()
    out = all_queries()["w5_settings_rolling_mean"](spark, path)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan and supplied._state(spark, path) not in supplied._stages
    rows = out.collect()
    supplied.labelled(spark, path)  # the same from the stage table
    assert sorted(all_queries()["w5_settings_rolling_mean"](spark, path).collect()) == sorted(rows)


@pytest.mark.parametrize("twice", ["part", "orders"])
def test_rows_of_repeated_keys_are_kept(spark, tables, twice):
    path = tables(twice)
    slim = data_queries.settings_telemetry(spark, path).groupBy("engine_id").agg(F.count("*").alias("n"), F.max("cycle").alias("last"))
    whole = supplied.telemetry(spark, path).groupBy("engine_id").agg(F.count("*").alias("n"), F.max("cycle").alias("last"))
    assert sorted(slim.collect()) == sorted(whole.collect())
    assert slim.agg(F.sum("n")).first()[0] == 2 * spark.read.parquet(f"{path}/lineitem.parquet").count()


def test_raw_text_is_compressed_and_has_no_labels_behind_it(spark, tables, monkeypatch):
    path, queries = tables(), all_queries()
    monkeypatch.setattr(text, "FILE_LINES", 100)
    back = queries["s1_raw_telemetry_text"](spark, path)
    assert all(f.endswith(".gz") for f in back.inputFiles()) and supplied._state(spark, path) not in supplied._stages
    counts = queries["s1_record_counts"](spark, path).agg(F.sum("lines"), F.sum("bad")).first()
    bad = queries["s1_bad_records"](spark, path).agg(F.sum("records"), F.bool_and("placed")).first()
    assert supplied._state(spark, path) not in supplied._stages and counts[1] == bad[0] > 0 and bad[1]
    plain = supplied.telemetry(spark, path)  # from the stage table
    assert counts[0] == plain.count() and sorted(back.select(plain.columns).collect()) == sorted(plain.collect())


def test_subset_components_write_no_features(spark, tables, monkeypatch):
    path, kept = tables(), []
    for module in (stages, model_queries):
        monkeypatch.setattr(module, "materialise", lambda df, label: kept.append(label) or df)
    rows = all_queries()["m7_subset_checks"](spark, path).collect()
    assert kept == [] and len(rows) == 4 and all(all(r[2:]) for r in rows)


@pytest.mark.parametrize("name", ["m5_forest_checks", "s7_saved_forest", "s3_model_inputs"])
def test_features_are_worked_out_where_engines_lie(spark, tables, monkeypatch, tmp_path, name):
    """No features are written but those of the stage, and windows over engines need no exchange of the labels' rows."""
    path, kept, wide = tables(), [], []
    monkeypatch.setattr(spark.conf, "get", (lambda f: lambda k, *d: str(tmp_path / "m") if k == "spark.bladewatch.models.dir" else f(k, *d))(spark.conf.get))
    monkeypatch.setattr(model_queries, "materialise", lambda df, label: kept.append(label) or df)
    save = stages.save_stage
    monkeypatch.setattr(stages, "save_stage", lambda df, *rest: wide.append(df._jdf.queryExecution().executedPlan().toString()) or save(df, *rest))
    rows = all_queries()[name](spark, path).collect()
    assert kept == [] and len(rows) == {"s3_model_inputs": 16}.get(name, 4) and (name != "s3_model_inputs" or len(wide) == 2)
    wide.append(data_queries.rolled(spark, path)._jdf.queryExecution().executedPlan().toString())
    assert all("hashpartitioning" not in p for p in wide) and "Window" in wide[-1]
    assert all(r["vote_share_holds"] for r in rows) if name == "m5_forest_checks" else all(r["rows"] > 0 for r in rows)


def test_a_bucket_has_whole_engines(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(s, "train", e, c, float(c * e)) for s in ("a", "b") for e in range(30) for c in range(5, 0, -1)],
                               "subset string, split string, engine_id long, cycle long, sensor_2 double").repartition(7)
    monkeypatch.setattr(stages, "LEAST_BUCKETS", 3)
    out = stages.save_buckets(df, str(tmp_path), "rows", 10)
    assert sorted(out.select(df.columns).collect()) == sorted(df.collect())
    files = out.groupBy("subset", "engine_id").agg(F.count_distinct(F.col("_metadata.file_path")).alias("n")).agg(F.max("n")).first()[0]
    assert files == 1 and len(out.inputFiles()) <= 6


def test_components_are_fitted_in_one_pass(spark):
    rng = np.random.default_rng(3)
    points = {s: rng.normal(size=(n, 3)) * [5.0, 2.0, 1.0] + at for s, n, at in (("a", 400, 1e6), ("b", 7, -3.0), ("c", 1, 2.0))}
    rows = [(s, *map(float, p)) for s, block in points.items() for p in block]
    seen = spark.sparkContext.accumulator(0)
    df = tune(spark).createDataFrame(rows, "subset string, x double, y double, z double").repartition(5)
    count = F.udf(lambda v: (seen.add(1), v)[1], "double").asNondeterministic()
    fitted = fit_components(df.withColumn("x", count("x")), ["x", "y", "z"])
    assert seen.value == len(rows)
    for name, block in points.items():
        assert np.allclose(fitted.means[name], block.mean(axis=0), rtol=1e-12)
        want = np.linalg.eigvalsh(np.cov(block.T))[::-1] if len(block) > 1 else np.zeros(3)
        assert np.allclose(fitted.variances[name], want, rtol=1e-9, atol=1e-12)
