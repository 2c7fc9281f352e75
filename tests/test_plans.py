"""The chained data stages on the supplied view."""

from pyspark.sql import functions as F

from bladewatch.plans.stages import run_data_stages
from bladewatch.sources.supplied import ground_truth, telemetry


def test_data_stages(spark, sf, tmp_path):
    view = telemetry(spark, sf, sensors=("sensor_2", "sensor_3", "sensor_9"))
    out = run_data_stages(view, ground_truth(spark, sf), str(tmp_path), regimes={"FD001": 1, "FD002": 2})
    assert out.count() == view.count()
    assert {"RUL", "RUL_capped", "_regime", "sensor_2_rolling_std", "setting_1_rolling_mean"} <= set(out.columns)
    assert out.filter(F.col("RUL") < 0).count() == 0 and out.agg(F.max("RUL_capped")).first()[0] <= 125
    steps = out.filter("split = 'train' and subset = 'FD001'").orderBy("engine_id", "cycle").select("RUL").limit(3)
    values = [r[0] for r in steps.collect()]
    assert values[0] - values[1] == 1 and values[1] - values[2] == 1
