"""Positions in a total order, found without one task that sorts everything."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsweave.session import stored


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def small(facts: DataFrame, label: str, most: int = 100_000) -> DataFrame:
    """``facts`` stored, and broadcast to what joins them if they are at most ``most`` rows."""
    facts = stored(facts, label)
    return F.broadcast(facts) if facts.count() <= most else facts


def with_position(
    df: DataFrame, order: Sequence[str | Column], within: Sequence[str] = (), name: str = "position"
) -> DataFrame:
    """``df`` with the place of each row in its group, from 0, as ``name``.

    Rows are dealt by ranges of (group, order) and sorted per range; ranges are
    counted, and the counts of earlier ranges shift the places.  What is ordered
    in one task besides is one row per range of a group.  Rows that tie in the
    whole order are spread by a salt and get places in an order of their own, so
    no group and no tie is heavy.  Two tables are stored: the salt and the ranges
    must stay the same when a lost executor's tasks run again.
    """
    salt, at, part = (free_name(df, n) for n in ("_salt", "_at", "_part"))
    groups = [F.col(c).asc_nulls_first() for c in within]
    line = [*groups, *order, F.col(salt)]
    salted = stored(df.withColumn(salt, F.rand(0)), "unranked")
    laid = stored(
        salted.repartitionByRange(*line)
        .sortWithinPartitions(*line)
        .drop(salt)
        .withColumn(at, F.monotonically_increasing_id()),
        "ranked",
    ).withColumn(part, F.shiftright(at, 33))

    # Names of their own for the columns of the small side.
    keys = {c: free_name(df, f"_of_{i}") for i, c in enumerate(within)}
    first, rows, shift, range_ = (free_name(df, n) for n in ("_first", "_rows", "_shift", "_range"))
    ranges = laid.groupBy(F.col(part).alias(range_), *[F.col(c).alias(k) for c, k in keys.items()]).agg(
        F.min(at).alias(first), F.count(F.lit(1)).alias(rows)
    )
    earlier = Window.partitionBy(*keys.values()).orderBy(range_).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(rows).over(earlier), F.lit(0))
    shifts = small(ranges.select(range_, *keys.values(), (before - F.col(first)).alias(shift)), "range-shifts")
    same = [F.col(part) == F.col(range_)] + [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()]
    return (
        laid.join(shifts, reduce(Column.__and__, same))
        .withColumn(name, F.col(at) + F.col(shift))
        .select(*df.columns, name)
    )


def with_ranks(
    df: DataFrame, value: str, within: Sequence[str] = (), ascending: bool = True, prefix: str = ""
) -> DataFrame:
    """``df`` with ``rank``, ``average_rank`` and ``percent_rank`` of ``value`` in its group.

    The ranks are those of the window functions of these names; rows that tie share
    the least rank, and the mean of the places they take as their average rank.
    Nulls come last and tie among themselves.  Places come from ``with_position``,
    and a tie that lies across ranges is put together by a combining aggregate.
    """
    order = F.col(value).asc_nulls_last() if ascending else F.col(value).desc_nulls_last()
    at = free_name(df, "_position")
    placed = with_position(df, [order], within, at)
    keys = {c: free_name(df, f"_tie_{i}") for i, c in enumerate((*within, value))}
    tied = placed.groupBy(*[F.col(c).alias(k) for c, k in keys.items()]).agg(
        F.min(at).alias("_least"), F.max(at).alias("_most")
    )
    groups = [keys[c] for c in within]
    total = tied.groupBy(*[F.col(g).alias(f"{g}_all") for g in groups]).agg((F.max("_most") + 1).alias("_total"))
    same = [F.col(g).eqNullSafe(F.col(f"{g}_all")) for g in groups] or [F.lit(True)]
    tied = tied.join(F.broadcast(total) if not groups else total, reduce(Column.__and__, same))
    met = [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()]
    percent = F.when(F.col("_total") > 1, F.col("_least") / (F.col("_total") - 1)).otherwise(F.lit(0.0))
    return placed.join(tied, reduce(Column.__and__, met)).select(
        *df.columns,
        (F.col("_least") + 1).alias(f"{prefix}rank"),
        ((F.col("_least") + F.col("_most")) / 2 + 1).alias(f"{prefix}average_rank"),
        percent.alias(f"{prefix}percent_rank"),
    )


def auc_by_rank(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """The area under the ROC curve, one row ``auc_roc``, from the ranks of the positives.

    Exact whatever ties; null where one of the classes does not occur.
    """
    placed = with_position(scored.select(F.col(label).alias("label"), F.col(score).alias("score")).dropna(), [F.col("score")])
    tied = placed.groupBy("score").agg(
        ((F.min("position") + F.max("position")) / 2 + 1).alias("rank"),
        F.sum(F.col("label").cast("double")).alias("positives"),
        F.count(F.lit(1)).alias("rows"),
    )
    sums = tied.agg(
        F.sum(F.col("rank") * F.col("positives")).alias("ranks"), F.sum("positives").alias("p"), F.sum("rows").alias("n")
    )
    rest = F.col("n") - F.col("p")
    return sums.select(F.try_divide(F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * rest).alias("auc_roc"))
