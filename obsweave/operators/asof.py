"""As-of joins: each row with the nearest row of another table before or after it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsweave.operators.series import HOUR_MICROS, floor_div, micros


def asof_join(
    left: DataFrame,
    right: DataFrame,
    values: Mapping[str, str | Column],
    *,
    key: str = "city",
    left_time: str = "timestamp",
    right_time: str = "timestamp",
    direction: str = "forward",
    tolerance_hours: float | None = None,
    bucket_hours: int = 24,
) -> DataFrame:
    """``left`` with ``values`` (name to expression over ``right``) of the nearest right row.

    ``forward`` takes the first right row of the same ``key`` at or after the left
    time, ``backward`` the last at or before it, neither further away than
    ``tolerance_hours``.  Left rows without one, without a key or without a time
    keep null values; right rows without a key or time are no candidates.  Of
    right rows at one time the one greatest by its values counts.

    Both tables are cut into buckets of ``bucket_hours`` and run through one
    window per (key, bucket), in which the last right row is carried along.  Rows
    beyond a bucket come from one edge row per bucket: what is ordered per key is
    one row per bucket, so a key that holds most of a table is spread over as many
    tasks as it has buckets.
    """
    if direction not in ("forward", "backward"):
        raise ValueError("direction is forward or backward")
    width = bucket_hours * HOUR_MICROS
    forward = direction == "forward"
    found = F.struct(*[(F.col(e) if isinstance(e, str) else e).alias(name) for name, e in values.items()])

    def placed(rows: DataFrame, time: str, content: Column, name: str) -> DataFrame:
        at = micros(F.col(time).cast("timestamp"))
        return rows.select(F.col(key).alias("key"), at.alias("at"), floor_div(at, width).alias("bucket"), content.alias(name))

    everything = F.struct(*[F.col(c) for c in left.columns])
    usable = F.col("key").isNotNull() & F.col("at").isNotNull()
    every = placed(left, left_time, everything, "row")
    probes, lost = every.where(usable).withColumn("probe", F.lit(True)), every.where(~usable)
    known = placed(right, right_time, found, "found").where(usable)
    known = known.withColumn("hit", F.struct("at", "found")).drop("found")

    # The nearest row beyond each bucket that holds probes.
    nearest = F.min("at") if forward else F.max("at")
    edges = known.groupBy("key", "bucket", "at").agg(F.max("hit").alias("hit"))
    edges = edges.groupBy("key", "bucket").agg((F.min_by if forward else F.max_by)("hit", "at").alias("edge"), nearest.alias("at"))
    wanted = probes.select("key", "bucket").distinct()
    line = edges.select("key", "bucket", "edge").unionByName(
        wanted.withColumn("edge", F.lit(None).cast(edges.schema["edge"].dataType))
    )
    line = line.groupBy("key", "bucket").agg(F.first("edge", ignorenulls=True).alias("edge"))
    along = Window.partitionBy("key").orderBy(F.col("bucket").desc() if forward else F.col("bucket"))
    beyond = F.last("edge", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    context = line.select("key", "bucket", beyond.alias("hit")).where("hit is not null")
    context = context.select("key", F.col("hit.at").alias("at"), "bucket", "hit")

    rows = probes.unionByName(known.unionByName(context), allowMissingColumns=True)
    order = F.col("at").desc() if forward else F.col("at")
    carried = Window.partitionBy("key", "bucket").orderBy(order, F.col("probe").asc_nulls_first(), "hit")
    hit = F.last("hit", ignorenulls=True).over(carried.rowsBetween(Window.unboundedPreceding, 0))
    near = F.lit(True)
    if tolerance_hours is not None:
        near = F.abs(F.col("hit.at") - F.col("at")) <= F.lit(int(tolerance_hours * HOUR_MICROS))
    # Rows that can meet nothing stay out of the windows, whose keys they would share.
    joined = rows.withColumn("hit", hit).where("probe").unionByName(lost, allowMissingColumns=True)
    return joined.select("row.*", *[F.when(near, F.col("hit.found")[name]).alias(name) for name in values])
