"""Forecast error metrics as aggregates over rows of actual and prediction. Undefined is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def metric_columns(actual: str = "actual", prediction: str = "validation_prediction") -> list[Column]:
    """mae, rmse, mape, wmape, forecast_bias, n_rows."""
    a, e = F.col(actual), F.col(prediction) - F.col(actual)
    total = F.sum(F.abs(a))
    return [
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.when(a != 0, F.abs(e) / F.abs(a))).alias("mape"),
        F.try_divide(F.sum(F.abs(e)), total).alias("wmape"),
        F.try_divide(F.sum(e), total).alias("forecast_bias"),
        F.count("*").alias("n_rows"),
    ]
