"""Prediction-error and interval columns, and the aggregates built on them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from bladewatch import constants as C
from bladewatch.functions.numeric import half_even


def nasa_penalty(truth: Column, predicted: Column) -> Column:
    """Asymmetric penalty: late predictions cost more than early ones."""
    d = predicted - truth
    return F.when(d < 0.0, F.exp(-d / F.lit(13.0)) - 1.0).otherwise(F.exp(d / F.lit(10.0)) - 1.0)


def absolute_error(truth: Column, predicted: Column) -> Column:
    return half_even(F.abs(predicted - truth), 2)


def regression_metrics(truth: Column, predicted: Column) -> list[Column]:
    """MAE, RMSE, R2 and penalty sum as one set of aggregates."""
    err = predicted - truth
    sse = F.sum(err * err)
    sst = F.var_pop(truth) * F.count(truth)
    return [
        F.count(truth).alias("n"),
        half_even(F.avg(F.abs(err)), 4).alias("mae"),
        half_even(F.sqrt(F.avg(err * err)), 4).alias("rmse"),
        half_even(F.lit(1.0) - F.try_divide(sse, sst), 4).alias("r2"),
        half_even(F.sum(nasa_penalty(truth, predicted)), 2).alias("nasa_score"),
    ]


def rul_bin(predicted: Column) -> Column:
    """Bin 0..4 of a predicted RUL."""
    index = F.lit(0)
    for edge in C.RUL_BIN_EDGES:
        index = index + F.when(predicted >= edge, 1).otherwise(0)
    return index.cast("int")


def default_offset(bin_index: Column, alpha: Column) -> Column:
    """Half-width used before any hold-out residuals are available."""
    scale = F.lit(5.0) + F.lit(4.0) * bin_index
    return scale * (F.lit(1.0) + F.lit(0.1) / alpha)
