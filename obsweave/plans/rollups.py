"""Statistics of several levels at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = {
    "hour": ("city", "hour"),
    "day": ("city", "day"),
    "month": ("city", "month"),
    "city": ("city",),
    "all": (),
}


def level_statistics(obs: DataFrame, value: str = "temperature", levels: tuple[str, ...] = tuple(LEVELS)) -> DataFrame:
    """``level, city, start, rows, avg, std, min, max`` of a measure, for every group of every level.

    ``start`` is where the hour, day or month begins; null columns belong to levels
    that do not split by them.  A station without a name is a group of its own in
    the levels that split by station.  Rows are expanded over the levels and
    combined before the one exchange; all statistics are sums, counts and extremes
    that merge.
    """
    unknown = set(levels) - set(LEVELS)
    if unknown:
        raise ValueError(f"no such levels: {sorted(unknown)}")
    parts = {part: F.date_trunc(part, "timestamp") for part in ("hour", "day", "month")}
    rows = obs.select("city", F.col(value).alias("_value"), *[c.alias(part) for part, c in parts.items()])
    columns = ("city", *parts)
    # One bit a column, from the left, set where a level does not split by it.
    bits = {level: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in LEVELS[level]) for level in levels}
    name = F.create_map(*[F.lit(x) for level, bit in bits.items() for x in (bit, level)])
    grouped = rows.groupingSets([[F.col(c) for c in LEVELS[level]] for level in levels], *columns).agg(
        F.grouping_id().alias("_bits"),
        F.count(F.lit(1)).alias("rows"),
        F.avg("_value").alias("avg"),
        F.stddev("_value").alias("std"),
        F.min("_value").alias("min"),
        F.max("_value").alias("max"),
    )
    return grouped.select(
        name[F.col("_bits").cast("int")].alias("level"),
        "city",
        F.coalesce(*parts).alias("start"),
        "rows",
        "avg",
        "std",
        "min",
        "max",
    )
