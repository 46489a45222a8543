"""Repeatable random splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsweave.functions.columns import hash_bucket

STEPS = 10_000


def split_bucket(*keys: str, seed: int | None = None, buckets: int = 100) -> Column:
    """Bucket of a row's key; the same however the table is partitioned."""
    parts = [F.col(k).cast("string") for k in keys]
    salt = [F.lit(str(seed))] if seed is not None else []
    return hash_bucket(*salt, *parts, buckets=buckets)


def hash_split(
    df: DataFrame, shares: tuple[float, ...], keys=("city", "timestamp"), seed: int = 42
) -> list[DataFrame]:
    """Disjoint parts of ``df`` with about the given shares, decided by key."""
    marked = df.withColumn("_bucket", split_bucket(*keys, seed=seed, buckets=STEPS))
    edges, parts, low = [], [], 0
    for share in shares:
        edges.append(low + round(share * STEPS))
        low = edges[-1]
    edges[-1] = STEPS
    low = 0
    for high in edges:
        inside = (F.col("_bucket") >= low) & (F.col("_bucket") < high)
        parts.append(marked.where(inside).drop("_bucket"))
        low = high
    return parts
