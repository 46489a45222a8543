"""Interval joins: points in time with the intervals that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsweave.operators.series import HOUR_MICROS, floor_div, micros


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    *,
    key: str = "city",
    time: str = "timestamp",
    start: str = "start",
    end: str = "end",
    name: str = "interval",
    how: str = "inner",
    bin_hours: int = 24,
) -> DataFrame:
    """Every point with every interval of its ``key`` that holds it, as the struct ``name``.

    Intervals are closed at both ends.  ``how="left"`` keeps points in none, with
    a null struct.  Points and intervals without a key or times meet nothing, nor
    does an interval that ends before it starts.

    Intervals are cut into bins of ``bin_hours``, one row each, and joined to
    points on (key, bin): a long interval is many light rows, points are not
    copied, and a pair can only meet in the point's own bin, so none comes twice.
    AQE splits a bin in which many of both meet.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    width = bin_hours * HOUR_MICROS

    def at(column: str):
        return micros(F.col(column).cast("timestamp"))

    held = intervals.select(F.struct(*[F.col(c) for c in intervals.columns]).alias("held"), F.col(key).alias("held_key"), at(start).alias("first"), at(end).alias("last"))
    held = held.where("first <= last and held_key is not null")
    bins = held.withColumn("held_bin", F.explode(F.sequence(floor_div(F.col("first"), width), floor_div(F.col("last"), width))))
    placed = points.select(F.struct(*[F.col(c) for c in points.columns]).alias("point"), F.col(key).alias("point_key"), at(time).alias("at"))
    placed = placed.withColumn("bin", floor_div(F.col("at"), width))
    inside = F.col("at").between(F.col("first"), F.col("last"))
    met = placed.join(bins, (F.col("point_key") == F.col("held_key")) & (F.col("bin") == F.col("held_bin")) & inside, how)
    return met.select("point.*", F.col("held").alias(name))
