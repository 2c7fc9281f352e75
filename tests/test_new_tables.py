"""Bad records, ordered stream features, fleet risk without fan-out, components per subset, offsets, lookups by a pushed filter."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bladewatch import constants as C
from bladewatch.catalog import all_queries
from bladewatch.operators import components, quality, risk, rul, uncertainty
from bladewatch.sources import supplied, text
from bladewatch.streaming import ordered, telemetry as streams


def test_every_line_is_good_bad_or_blank(spark, tmp_path):
    cells = [str(k) for k in range(1, 27)]
    lines = {
        "train_FD001.txt": [" ".join(cells), " ".join(cells[:12]), "", "  ".join(cells) + "  ", " ".join([*cells, "9"]),
                            " ".join(["1.5", *cells[1:]]), " ".join([*cells[:-1], "n/a"]), "\t".join(["2", "3e0", *cells[2:]])],
        "test_FD005.txt": ["x", "", " ".join(cells)] * 40}
    for name, rows in lines.items():
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400b")  # many blocks of one file
    try:
        counts = {r["file"].rsplit("/", 1)[1]: (r["lines"], r["blank"], r["good"], r["bad"])
                  for r in text.record_counts(spark, str(tmp_path)).collect()}
        bad = {(r["file"].rsplit("/", 1)[1], r["line_number"]): r["problem"] for r in text.bad_records(spark, str(tmp_path)).collect()}
        good = text.read_telemetry(spark, str(tmp_path), strict=False)
        assert good.filter("subset = 'FD001'").count() == 3 and good.filter("subset = 'FD005'").count() == 40
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert counts == {"train_FD001.txt": (8, 1, 3, 4), "test_FD005.txt": (120, 40, 40, 40)}
    assert {k: v for k, v in bad.items() if k[0] == "train_FD001.txt"} == {
        ("train_FD001.txt", 2): "expected 26 columns, found 12", ("train_FD001.txt", 5): "expected 26 columns, found 27",
        ("train_FD001.txt", 6): "not a whole number", ("train_FD001.txt", 7): "not a number"}
    assert {n for f, n in bad if f == "test_FD005.txt"} == set(range(1, 121, 3))
    with pytest.raises(Exception, match="columns, found|number in"):
        text.read_telemetry(spark, str(tmp_path)).collect()


def _batch(spark, path, rows):
    data = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), user, "x", value, '{"k": 1}') for i, s, user, value in rows]
    spark.createDataFrame(data, streams.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_ordered_stream_with_late_repeated_and_missing_readings(spark, tmp_path):
    path = str(tmp_path / "in")
    first = [(1, 0, 1, 10.0), (3, 130, 1, 30.0), (4, 700, 1, None), (5, 20, 2, 5.0)]
    second = [(2, 70, 1, 20.0), (3, 130, 1, 30.0), (6, 1500, 1, 60.0), (7, 5, 2, 7.0)]
    third = [(8, 40, 1, 99.0), (9, 4000, 1, 1.0), (10, 4000, 2, 1.0)]  # the first comes later than the delay allows
    for rows in (first, second, third):
        _batch(spark, path, rows)
    stream = streams.read_events(spark, path, "*.parquet", files_per_batch=1)
    out = streams.run_to_table(ordered.ordered_rolling_stream(stream, "10 minutes", window=3), str(tmp_path / "out"))
    got = {}
    for r in out.orderBy("engine_id", "at").collect():
        got.setdefault(r["engine_id"] - 1, []).append((r["event_id"], r["rolling_mean"], r["rolling_std"], r["diff"], r["pct_change"]))
    assert [g[0] for g in got[1]] == [1, 2, 3, 4, 6] and [g[0] for g in got[2]] == [7, 5]
    assert got[1][2][1:] == pytest.approx((20.0, 10.0, 10.0, 50.0))
    assert got[1][3][1:] == pytest.approx((25.0, float(np.std([20, 30], ddof=1)), 0.0, 0.0))  # the missing reading itself
    assert got[1][4][1:] == pytest.approx((45.0, float(np.std([30, 60], ddof=1)), 0.0, 0.0))
    assert got[2][1][1:] == pytest.approx((6.0, float(np.std([7, 5], ddof=1)), -2.0, -200.0 / 7.0))


def test_an_idle_engine_loses_its_window(spark, tmp_path):
    path = str(tmp_path / "in")
    for rows in ([(1, 0, 1, 10.0)], [(2, 5000, 1, 20.0)], [(3, 20000, 1, 40.0)], [(4, 20001, 2, 0.0)], [(5, 30000, 2, 0.0)]):
        _batch(spark, path, rows)
    stream = streams.read_events(spark, path, "*.parquet", files_per_batch=1)
    out = streams.run_to_table(ordered.ordered_rolling_stream(stream, "1 minute", idle_seconds=6000), str(tmp_path / "out"))
    assert {r["event_id"]: r["rolling_mean"] for r in out.collect() if r["event_id"] < 4} == {1: 10.0, 2: 15.0, 3: 40.0}


def test_counts_of_all_simulations_without_a_row_each(spark):
    fleet = spark.createDataFrame(
        [(f"FD00{k % 2}", "test", k, float(7 * k % 90)) for k in range(30)], "subset string, split string, engine_id int, predicted_RUL double")
    drawn = risk.own_draws(fleet, 50).collect()
    shocks = risk._shocks(spark, 50, C.SEED)
    want = {}
    for r in drawn:
        draws = np.maximum(np.array(r["own"]) + C.COMMON_SHOCK * r["draw_std"] * shocks, 0.0)
        for days in C.HORIZON_DAYS:
            cell = want.setdefault((r["subset"], days), np.zeros(50, int))
            cell += draws <= days * C.CYCLES_PER_DAY
    for parts in (1, 7):
        got = {}
        for r in risk.simulation_counts(fleet.repartition(parts), 50).collect():
            got.setdefault((r["subset"], r["horizon_days"]), [0] * 50)[r["sim"]] = r["down"]
        assert {k: list(v) for k, v in want.items()} == got
    assert risk.simulation_counts(fleet.limit(0), 50).count() == 0


def test_components_of_each_subset(spark):
    rng = np.random.default_rng(3)
    spread = {"A": (9.0, 3.0, 1.0), "B": (1.0, 2.0, 8.0)}
    rows = [(s, *(float(v) for v in rng.normal(size=3) * spread[s] + 100.0)) for s in spread for _ in range(400)]
    df = spark.createDataFrame([*rows, ("A", None, 100.0, 100.0), ("C", 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0)],
                               "subset string, x double, y double, z double").repartition(5)
    fitted = components.fit_components(df.filter("subset <> 'C'"), ["x", "y", "z"])
    for s in spread:
        own = np.array([[v or 0.0 for v in r[1:]] for r in df.filter(F.col("subset") == s).collect()])
        values, vectors = np.linalg.eigh(np.cov(own.T))
        assert np.allclose(fitted.variances[s], values[::-1])
        assert np.allclose(np.abs(fitted.axes[s] @ vectors[:, ::-1][:, :2]), np.eye(2), atol=1e-9)
        assert np.allclose(fitted.shares(s), values[::-1][:2] / values.sum())
    out = fitted.project(df).groupBy("subset").agg(F.avg("pc_1").alias("m"), F.var_samp("pc_1").alias("v")).collect()
    by = {r["subset"]: r for r in out}
    assert by["C"]["m"] is None and by[None]["m"] is None
    assert by["B"]["m"] == pytest.approx(0.0, abs=1e-9) and by["B"]["v"] == pytest.approx(fitted.variances["B"][0])


def test_subsets_without_residuals_get_default_offsets(spark):
    fitted = spark.createDataFrame([("FD001", 0, 0.1, -1.0, 2.0)], "subset string, bin int, alpha double, lo double, hi double")
    subsets = spark.createDataFrame([("FD001",), ("FD009",), ("FD009",)], "subset string")
    out = uncertainty.complete_offsets(fitted, subsets)
    assert out.filter("subset = 'FD001'").count() == 1 and out.filter("subset = 'FD009'").count() == 5 * len(C.ALPHAS)
    rows = spark.createDataFrame([("FD009", 50.0, 50.0)], "subset string, predicted_RUL double, true_RUL double")
    wide = uncertainty.add_interval(rows, out, 0.1).first()
    plain = uncertainty.add_interval(rows, uncertainty.default_offsets(spark), 0.1).first()
    assert (wide["lower"], wide["upper"]) == (plain["lower"], plain["upper"])


def test_models_that_never_saw_an_engine(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(s, "train", e, c, float(rng.normal() + c), float(100 - c)) for s, n in (("S1", 12), ("S2", 1)) for e in range(n)
            for c in range(20)]
    train = spark.createDataFrame(rows, "subset string, split string, engine_id int, cycle int, sensor_2 double, RUL_capped double")
    rul.write_cross_fitted(train, spark, str(tmp_path / "m"), "random_forest", folds=3, numTrees=3, maxDepth=3)
    scorer = rul.load_scorer(spark, str(tmp_path / "m"))
    folds = {r[0] for r in train.filter("subset = 'S1'").select(uncertainty.fold_of(F.col("engine_id"), 3)).distinct().collect()}
    assert set(scorer.groups) == {f"S1/{f}" for f in folds}
    out = rul.predict_out_of_fold(scorer, train, 3).groupBy("subset").agg(F.count("predicted_RUL").alias("n")).collect()
    assert {r["subset"]: r["n"] for r in out} == {"S1": 240, "S2": 0}


def test_frames_with_other_columns_fail_the_check(spark, sf):
    train = supplied.labelled(spark, sf).filter("split = 'train'")
    same = {r["check"]: r["violations"] for r in quality.frame_checks(train, train).collect()}
    assert same["same_columns"] == 0 and same["no_missing"] == 0
    other = quality.frame_checks(train, train.drop("sensor_9").withColumn("extra", F.lit(None).cast("double")))
    assert {r["violations"] for r in other.filter("check = 'same_columns'").collect()} == {2}
    assert other.filter("check = 'no_missing' AND NOT passed").count() > 0


def test_labels_are_read_from_one_stage_table(spark, sf):
    queries = all_queries()
    for name in ("e10_explain_anomalies", "e17_assess_frame", "p12_engine_history", "v13_sample_timelines", "a15_priority_ranking"):
        plan = queries[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "l_suppkey" not in plan and "p_retailprice" not in plan, name


def test_the_stage_table_follows_its_input(spark, sf, tmp_path):
    tables = ("lineitem", "orders", "part", "supplier")
    for t in tables:
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    n = supplied.labelled(spark, str(tmp_path)).count()
    spark.read.parquet(f"{sf}/lineitem.parquet").limit(7).write.mode("append").parquet(str(tmp_path / "lineitem.parquet"))
    assert supplied.labelled(spark, str(tmp_path)).count() == n + 7


def test_an_engine_is_found_by_a_filter_in_the_scan(spark, sf):
    rows = supplied.labelled(spark, sf).filter("subset = 'FD002' AND engine_id = 2")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(engine_id), EqualTo(engine_id,2)]" in plan and "(subset" in plan.split("PartitionFilters")[1][:80]
    assert rows.count() > 0
    for name in ("p11_one_engine", "p12_one_engine"):
        found = all_queries()[name](spark, sf)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(engine_id,8)" in plan and "rangepartitioning" not in plan and found.count() > 0, name


class _Handle:
    """State in memory that counts the calls."""

    def __init__(self):
        self.calls, self.timers, self.kept = 0, set(), {}

    def _state(self, name):
        kept, handle = self.kept.setdefault(name, {}), self

        class State:
            def __getattr__(self, what):
                handle.calls += 1
                return {"exists": lambda: None in kept, "get": lambda: kept[None], "update": lambda v: kept.update({None: v}),
                        "clear": kept.clear, "keys": lambda: list(kept), "containsKey": kept.__contains__,
                        "getValue": kept.__getitem__, "updateValue": kept.__setitem__, "removeKey": kept.pop}[what]

        return State()

    def getValueState(self, name, _):
        return self._state(name)

    def getMapState(self, name, *_):
        return self._state(name)

    def registerTimer(self, time):
        self.timers.add(time)

    def deleteTimer(self, time):
        self.timers.remove(time)


class _Watermark:
    def __init__(self, time):
        self.time = time

    def getCurrentWatermarkInMs(self):
        return self.time


def _taken_in_order(few, batches, idle=3000):
    handle, out = _Handle(), []
    processor = ordered.OrderedRolling(3, 60, idle, few)
    processor.init(handle)
    for rows, watermark in batches:
        frame = pd.DataFrame({"at": pd.to_datetime([r[0] for r in rows], unit="s"), "event_id": [r[1] for r in rows],
                              "reading": [r[2] for r in rows]})
        list(processor.handleInputRows((7,), iter([frame[:5], frame[5:]]), None))
        for due in [t for t in handle.timers if t <= watermark * 1000]:
            handle.timers.remove(due)
            out += list(processor.handleExpiredTimer((7,), _Watermark(watermark * 1000), None))
    return pd.concat(out, ignore_index=True), handle


def test_an_engine_with_few_readings_costs_few_state_calls():
    rng = np.random.default_rng(3)
    times = [int(t) for t in np.cumsum(rng.choice([0, 20, 90, 600, 4000], 300))]
    rows = [(t, k, None if k % 17 == 0 else float(rng.normal())) for k, t in enumerate(times)]
    late = [*rows[150:10:-1], *rows[100:120], *rows[:11]]  # out of order, some twice
    batches = [(late, times[120]), (rows[151:], times[-1] + 61)]
    quick, handle = _taken_in_order(10**6, batches)
    slow, by_slot = _taken_in_order(20, batches)
    pd.testing.assert_frame_equal(quick, slow)
    assert quick["event_id"].tolist() == list(range(300))
    assert handle.calls <= 15 < 300 < by_slot.calls
    assert not handle.kept["open"] and not by_slot.kept["open"]


def test_blank_lines_are_left_out_without_parsing_each_line_twice(spark, sf, tmp_path):
    (tmp_path / "train_FD001.txt").write_text("1 1 " + "0.5 " * 24 + "\n   \n\t\n1 2 x " + "0.5 " * 23 + "\n")
    read = text.read_telemetry(spark, str(tmp_path / "train_FD001.txt"), strict=False)
    assert [(r["subset"], r["split"], r["engine_id"], r["cycle"]) for r in read.collect()] == [("FD001", "train", 1, 1)]
    for strict in (True, False):
        plan = text.read_telemetry(spark, str(tmp_path / "train_FD001.txt"), strict)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("try_cast") == 1
