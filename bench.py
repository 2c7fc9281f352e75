"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the cores, ``BENCH_QUERIES`` an optional list of names.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from bladewatch.catalog import all_queries  # noqa: E402
from bladewatch.session import local_session  # noqa: E402

HEADLINE = (
    "p6_quality_report", "e1_train_rul", "a3_sensor_statistics", "w1_rolling_mean", "w2_rolling_std",
    "m2_regime_normalised", "e10_explain_anomalies", "e17_assess_frame", "e19_action_items", "j4_cycle_advisory",
    "a11_engine_summary", "a14_executive_report", "a15_priority_ranking", "a16_fleet_costs", "a18_conformal_offsets",
    "v2_correlation_matrix", "m1_operating_regimes", "m5_isolation_forest", "a19_horizon_summary",
    "t1_stream_scoring", "t2_stream_rolling_features", "t3_stream_anomaly_rate",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    queries = all_queries()
    spark.range(1_000_000).selectExpr("sum(id)").collect()  # starts the executors before the clock does
    took = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
