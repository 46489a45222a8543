"""How predictions turned out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsweave.operators.asof import asof_join


def realised(predictions: DataFrame, obs: DataFrame, tolerance_hours: float | None = None) -> DataFrame:
    """Stored predictions with the observation that came true and their error.

    A prediction is for its source time plus the horizon (1 hour where none is
    stored); what came true is the first observation of the station at or after
    that, no later than ``tolerance_hours``.  Adds ``target_timestamp``,
    ``realised_timestamp``, ``realised_temperature``, ``error`` and
    ``absolute_error``; predictions whose time is still to come have nulls.
    """
    hours = F.coalesce("horizon_hours", F.lit(1))
    target = F.col("source_timestamp") + F.make_dt_interval(hours=hours)
    joined = asof_join(
        predictions.withColumn("target_timestamp", target),
        obs,
        {"realised_timestamp": "timestamp", "realised_temperature": "temperature"},
        left_time="target_timestamp",
        tolerance_hours=tolerance_hours,
    )
    error = F.col("realised_temperature") - F.col("predicted_temperature")
    return joined.withColumn("error", error).withColumn("absolute_error", F.abs("error"))


def error_summary(evaluated: DataFrame, by: tuple[str, ...] = ("city", "horizon_hours")) -> DataFrame:
    """``by``, ``predictions, realised, bias, mae, rmse`` per group."""
    return evaluated.groupBy(*by).agg(
        F.count(F.lit(1)).alias("predictions"),
        F.count("error").alias("realised"),
        F.avg("error").alias("bias"),
        F.avg("absolute_error").alias("mae"),
        F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"),
    )
