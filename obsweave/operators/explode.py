"""Column arrays to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_series(
    df: DataFrame,
    time: str,
    values: Sequence[str],
    keep: Sequence[str | Column] = (),
) -> DataFrame:
    """One row per element of the ``time`` array, with the value arrays beside it.

    A value array that is shorter, or missing altogether, gives nulls; an empty
    time array gives no rows; elements past the end of the times are dropped.
    """
    arrays = [F.coalesce(F.col(v), F.array()).alias(v) for v in values]
    points = F.slice(F.arrays_zip(F.col(time).alias(time), *arrays), F.lit(1), F.size(time))
    return (
        df.where(F.size(time) > 0)
        .select(*keep, F.explode(points).alias("_point"))
        .select("*", "_point.*")
        .drop("_point")
    )
