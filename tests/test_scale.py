"""Forms for oversized engines give the same rows as the plain ones; plans keep their shape."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bladewatch import constants as C
from bladewatch.catalog import model_queries
from bladewatch.operators import explain, features, iforest, labels, plotdata, risk, rul, stats
from bladewatch.operators.faults import detection_latency, fault_effects
from bladewatch.operators.ranks import exact_percentiles
from bladewatch.sources import supplied, text
from bladewatch.sources.stages import StageMissing, load_model_inputs, save_stage


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def gappy(spark):
    rng = np.random.default_rng(1)
    parts = []
    for e in range(1, 5):
        cycles = np.sort(rng.choice(np.arange(1, 200), size=60 if e < 4 else 1, replace=False))
        parts.append(pd.DataFrame({"subset": "FD001", "split": "train", "engine_id": e, "cycle": cycles,
                                   "setting_1": rng.random(len(cycles)), "sensor_2": rng.normal(size=len(cycles))}))
    return spark.createDataFrame(pd.concat(parts)).cache()


def test_blocked_features_equal_plain(gappy):
    plain = features.engineer_features(gappy, split_hot=False)
    for block in (3, 10, 64):
        blocked = features.engineer_features(gappy, split_hot=True, block_cycles=block)
        a, b = plain.toPandas(), blocked.select(plain.columns).toPandas()
        key = ["engine_id", "cycle"]
        pd.testing.assert_frame_equal(a.sort_values(key, ignore_index=True), b.sort_values(key, ignore_index=True))


def test_features_have_one_exchange(gappy):
    df = features.engineer_features(gappy, split_hot=False)
    assert plan(df).count("Exchange hashpartitioning") == 1 and "Python" not in plan(df)


def test_split_view_equals_plain(spark, sf):
    plain = rows(supplied.labelled(spark, sf))
    spark.conf.set("spark.bladewatch.maxUnitRows", "100")
    try:
        assert supplied.hot_units(spark, sf)
        assert rows(supplied.labelled(spark, sf)) == plain
    finally:
        spark.conf.unset("spark.bladewatch.maxUnitRows")


@pytest.mark.parametrize("parts", [1, 8, 64])
def test_exact_percentiles(spark, parts):
    rng = np.random.default_rng(2)
    cells = {
        ("a", "x"): np.concatenate([rng.normal(size=3000), np.full(1500, 0.25)]), ("a", "y"): rng.normal(size=4500) * 1e300,
        ("b", "x"): np.array([-0.0, 0.0, -1e-320, 5e-324, np.inf, -np.inf, 7.0]), ("b", "y"): np.array([3.0] * 7),
        (None, "x"): np.array([2.0, np.nan, 1.0]), (None, "y"): np.array([np.nan] * 3)}
    frame = pd.concat([pd.DataFrame({"g": g, "x": cells[g, "x"], "y": cells[g, "y"]}) for g in ("a", "b", None)])
    df = spark.createDataFrame(frame, "g string, x double, y double").repartition(parts)
    probs = [0.0, 0.005, 0.25, 0.5, 0.75, 0.995, 1.0]
    got = {(r.g, r.column, r.p): r.value for r in exact_percentiles(df, ["g"], ["x", "y"], probs).collect()}
    assert len(got) == 5 * len(probs)
    for (g, c, p), value in got.items():
        known = np.sort(cells[g, c][~np.isnan(cells[g, c])])
        rank = p * (len(known) - 1)
        low, high = known[int(np.floor(rank))], known[int(np.ceil(rank))]
        want = low if low == high else low + (high - low) * (rank - np.floor(rank))
        assert value == want or np.isnan(value) and np.isnan(want)


def test_percentiles_of_nothing(spark):
    none = spark.createDataFrame([], "g string, x double")
    assert exact_percentiles(none, ["g"], ["x"], [0.5]).count() == 0


def test_blocked_spans_latency_and_effects(spark, gappy):
    scored = gappy.withColumn("anomaly_label", F.when(F.col("sensor_2") > -0.5, "Anomalous").otherwise("Normal"))
    assert rows(plotdata.anomalous_spans(scored)) == rows(plotdata.anomalous_spans(scored, block=7))
    faults = [f for f, *_ in C.FAULTS]
    inj = spark.createDataFrame(
        [("FD001", "train", 1 + i % 4, faults[i % 5], 0.5 + i / 10, 1 + 11 * i) for i in range(16)],
        "subset string, split string, engine_id bigint, fault string, magnitude double, injected_at_cycle bigint")
    scored = scored.withColumn("faulted_score", F.abs("sensor_2") * 40)
    assert rows(detection_latency(inj, scored).fillna(-1)) == rows(detection_latency(inj, scored, block=9).fillna(-1))
    ramps = {f: (o, r) for f, _, o, r, _ in C.FAULTS}
    pairs = inj.collect()
    active, _ = fault_effects(gappy, inj, block=13)
    for r in active.collect():
        for f in faults:
            want = sum(p.magnitude * (1.0 if ramps[f][0] == "step" else min(
                1.0, (r.cycle - p.injected_at_cycle) / ramps[f][1])) for p in pairs
                if p.engine_id == r.engine_id and p.fault == f and r.cycle >= p.injected_at_cycle)
            assert r[f"effect_{f}"] == pytest.approx(want, abs=1e-9)


def test_truth_count_mismatch_raises(spark):
    test = spark.createDataFrame([("FD001", "test", 1, 1), ("FD001", "test", 2, 1)],
                                 "subset string, split string, engine_id bigint, cycle bigint")
    truth = spark.createDataFrame([("FD001", 1, 5)], "subset string, engine_ordinal bigint, true_rul bigint")
    with pytest.raises(ValueError, match="2 engines and 1 lines"):
        labels.check_truth_counts(test, truth)


def test_text_sources(spark, tmp_path):
    record = " ".join(["1", "1"] + ["0.5"] * 24)
    (tmp_path / "train_FD003.txt").write_text(record + "  \n" + record.replace("1 1", "1  2", 1) + "\n\n")
    df = text.read_telemetry(spark, str(tmp_path / "train_FD003.txt"))
    assert [(r.subset, r.split, r.engine_id, r.cycle) for r in df.orderBy("cycle").collect()] == [
        ("FD003", "train", 1, 1), ("FD003", "train", 1, 2)]
    (tmp_path / "test_FD003.txt").write_text("1 2 3\n")
    with pytest.raises(Exception, match="expected 26 columns"):
        text.read_telemetry(spark, str(tmp_path / "test_FD003.txt")).collect()
    numbers = list(range(500, 900))
    (tmp_path / "RUL_FD004.txt").write_text("\n".join(map(str, numbers)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        truth = text.read_truth(spark, str(tmp_path / "RUL_FD004.txt"))
        assert truth.rdd.getNumPartitions() > 0
        got = {r.engine_ordinal: r.true_rul for r in truth.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {i + 1: n for i, n in enumerate(numbers)}


def test_missing_stage_and_fallback(spark, gappy, tmp_path):
    with pytest.raises(StageMissing):
        load_model_inputs(spark, str(tmp_path))
    save_stage(gappy, str(tmp_path), "processed")
    assert load_model_inputs(spark, str(tmp_path), "FD001").count() == gappy.count()


def test_isolation_forest(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 2))
    x[:20] += 8
    df = spark.createDataFrame(pd.DataFrame({
        "subset": "FD001", "split": "train", "engine_id": np.arange(2000) % 10, "cycle": np.arange(2000),
        "a": x[:, 0], "b": x[:, 1]}))
    one = iforest.fit_forest(df, ["a", "b"], trees=40)
    two = iforest.fit_forest(df.repartition(7), ["a", "b"], trees=40)
    key = ["tree", "node"]
    pd.testing.assert_frame_equal(one.nodes.sort_values(key, ignore_index=True),
                                  two.nodes.sort_values(key, ignore_index=True))
    scored = one.score(df).toPandas()
    assert scored[scored.cycle < 20].anomaly_score.min() > scored[scored.cycle >= 20].anomaly_score.median()
    assert abs((scored.anomaly_vote == -1).mean() - C.FOREST_CONTAMINATION) < 0.01
    one.save(spark, str(tmp_path / "f"))
    again = iforest.IsolationForest.load(spark, str(tmp_path / "f")).score(df).toPandas()
    assert (again.sort_values("cycle").anomaly_score.to_numpy() == scored.sort_values("cycle").anomaly_score.to_numpy()
            ).all()


def test_transfer_penalties(spark):
    cells = spark.createDataFrame([("A", "A", 10.0, 8.0), ("A", "B", 15.0, 9.0), ("B", "B", 5.0, 4.0)],
                                  "source string, target string, rmse double, mae double")
    matrix = rul.transfer_penalties(cells)
    assert {(r.source, r.target): r.transfer_penalty_pct for r in matrix.collect()} == {
        ("A", "A"): 0.0, ("A", "B"): 50.0, ("B", "B"): 0.0}
    assert rul.transfer_summary(matrix).first().transfer_degradation_pct == 100.0


def test_no_row_is_shuffled_or_sorted_for_baselines_and_last_rows(spark):
    """Healthy rows need no exchange of rows, and last rows of fixed size and engine summaries no sort of them."""
    cells = [(s, "train", e, c, 120 - c if s == "A" else 5, float(c * e), "x" if c > 3 else "y", "Anomalous" if c % 7 == 3 else "Normal",
              ["sensor_2", "sensor_3"][c % 2]) for s in ("A", "B") for e in (1, 2) for c in range(1, 81)]
    df = spark.createDataFrame(cells, "subset string, split string, engine_id long, cycle long, RUL_capped long, sensor_2 double, "
                                      "anomaly_severity string, anomaly_label string, lead string").withColumns({
        "ranked_sensors": F.array("lead"), "anomaly_score": F.col("sensor_2")})
    moments = stats.baseline_moments(df)
    got = {r["subset"]: r["mean_sensor_2"] for r in moments.collect()}
    late = [x[5] for x in cells if x[0] == "A" and x[4] >= C.HEALTHY_RUL]
    early = [x[5] for x in cells if x[0] == "B" and x[3] <= C.EARLY_CYCLES]
    assert len(late) < C.MIN_HEALTHY_ROWS or got["A"] == pytest.approx(np.mean(late))
    assert got["B"] == pytest.approx(np.mean(early))
    for line in plan(moments).splitlines():  # ranks are limited before rows are exchanged
        assert "Window [" not in line or "row_number" in line
    assert "WindowGroupLimit" in plan(moments)
    numbers = df.select(*C.UNIT, "cycle", "sensor_2", "RUL_capped")
    assert "Sort" not in plan(features.engine_tail(numbers))
    assert rows(features.engine_tail(numbers)) == rows(numbers.filter("cycle = 80"))
    summary = explain.engine_summary(df)
    assert any(" HashAggregate(" in line and "anomaly_severity" in line.split("functions=")[0] for line in plan(summary).splitlines())
    for r in summary.collect():
        assert (r["last_observed_cycle"], r["final_anomaly_score"], r["final_anomaly_severity"], r["final_anomaly_status"]) == (
            80, 80.0 * r["engine_id"], "x", "Anomalous" if 80 % 7 == 3 else "Normal")
        assert (r["total_cycles_observed"], r["total_anomalous_cycles"], r["first_anomalous_cycle"]) == (80, 12, 3)


def test_regimes_write_no_features(spark, sf, monkeypatch):
    written = []
    monkeypatch.setattr(model_queries, "_kept", {})
    monkeypatch.setattr(model_queries, "materialise", lambda df, label: written.append(label) or df)
    assert model_queries.m1_operating_regimes(spark, sf).count() == 8 and not written
    assert model_queries.s7_saved_regimes(spark, sf).filter("difference > 0").count() == 0 and not written
    model_queries._staged(spark, sf)
    assert written == ["features"]


def test_draws_of_few_engines_are_dealt_to_many_tasks(spark):
    fleet = spark.createDataFrame([("A", "test", e, 20.0) for e in range(200)], "subset string, split string, engine_id long, predicted_RUL double")
    drawn = risk.own_draws(fleet.coalesce(1), 3)
    assert drawn.rdd.getNumPartitions() == risk.PARTS
