"""The data stages chained: raw telemetry to cleaned, processed and feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bladewatch.constants import RUL_CAP, SUBSET_REGIMES
from bladewatch.operators.features import engineer_features
from bladewatch.operators.labels import add_rul, check_truth_counts
from bladewatch.operators.ordering import has_oversized_unit
from bladewatch.operators.quality import clean
from bladewatch.operators.regimes import assign_regime, fit_subset_regimes, normalise, regime_statistics
from bladewatch.sources.stages import load_stage, save_stage


def run_data_stages(raw: DataFrame, truth: DataFrame, root: str, cap: int = RUL_CAP, regimes=None) -> DataFrame:
    """Writes the cleaned, processed and feature tables below ``root`` and returns the features.

    All subsets run together; regimes and moments are fitted on the training split only.
    """
    spark = raw.sparkSession
    check_truth_counts(raw.filter(F.col("split") == "test"), truth)
    save_stage(clean(raw), root, "cleaned")
    cleaned = load_stage(spark, root, "cleaned")
    hot = has_oversized_unit(cleaned)
    labelled = add_rul(cleaned, truth, cap, split_hot=hot)
    train = labelled.filter(F.col("split") == "train")
    centres = fit_subset_regimes(train, SUBSET_REGIMES if regimes is None else regimes)
    placed = assign_regime(labelled, centres)
    moments = regime_statistics(placed.filter(F.col("split") == "train"))
    save_stage(normalise(placed, moments), root, "processed")
    processed = load_stage(spark, root, "processed")
    save_stage(engineer_features(processed, split_hot=hot), root, "features")
    return load_stage(spark, root, "features")
