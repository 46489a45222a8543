"""Newest row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_rows(df: DataFrame, key: str = "city", time: str = "timestamp") -> DataFrame:
    """Every row at its key's greatest time; rows that tie all stay.

    The maximum is pre-aggregated before its shuffle, and the join key holds
    the time too, so tied copies stream through the join instead of meeting in
    one window partition.  AQE turns the join into a broadcast when the
    measured maxima are small and splits skewed partitions otherwise.
    """
    greatest = df.groupBy(key).agg(F.max(time).alias(time))
    return df.join(greatest, [key, time], "inner").select(*df.columns)


def newest_row(
    df: DataFrame,
    key: str | Sequence[str] = "city",
    time: str = "timestamp",
    tie_break: Sequence[Column] = (),
    ascending: str | None = None,
) -> DataFrame:
    """Exactly one row per key.  Each task keeps one row per key before the shuffle.

    With ``ascending`` it is the one least in that column, else the newest.
    """
    keys = [key] if isinstance(key, str) else list(key)
    first = F.col(ascending).asc() if ascending else F.col(time).desc()
    order = Window.partitionBy(*keys).orderBy(first, *tie_break)
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def on_newest_days(df: DataFrame, key: str = "city", time: str = "timestamp") -> DataFrame:
    """Of a table with day partitions, those that hold the newest row of some key.

    Two columns of the whole table tell which; only those days are then read in
    full.  A frame without days is returned as it is.
    """
    if "day" not in df.columns:
        return df
    greatest = df.groupBy(key).agg(F.max(time).alias("newest"))
    days = greatest.select(F.to_date("newest")).distinct().dropna().collect()  # bounded by the calendar
    return df.where(F.col("day").isin([day for (day,) in days]))
