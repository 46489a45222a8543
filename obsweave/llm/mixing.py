"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, its source's
target over its size.  The whole part is taken; the fractions are rounded
pairwise: two documents trade expected words at random until one of them is
integral, so expected copies hold for each document and the words of the pair
never change.  A chunk of a source ends with one fractional document; these
residuals meet in a reduction tree, and the last one of a source decides alone.
The words taken thus miss the target by less than one document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obsweave.llm.common import kept, whole_text

WORD = r"[^\x20\x09-\x0D]+"
CHUNK_ROWS = 10_000  # rows that one pivotal pass rounds
FAN_IN = 1_000  # residuals that meet in one node of the tree

_MIXED = (
    "doc_id string, source string, size bigint, source_size bigint, target double, "
    "whole bigint, part double, node bigint, done boolean"
)


def numbered(frame: DataFrame, order) -> DataFrame:
    """``position`` (from 0) of each row in the given order, without one sorting task."""
    ranged = kept(frame.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranges")
    before, start = {}, 0
    for row in ranged.groupBy("_range").count().orderBy("_range").collect():  # one row a partition
        before[row["_range"]], start = start, start + row["count"]
    offset = F.lit(0)
    if before:
        offset = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("_range"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return ranged.withColumn("position", offset + place).drop("_range")


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``sources`` (``source, source_size``) with ``target``.

    Weights repeat over the sources by code point, null last.  A target stops at
    ``most`` times its source; the excess is shared again by weight until no
    target is above.  Each round is one aggregate.
    """
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights)).cast("int"))
    ranked = kept(numbered(sources, F.col("source").asc_nulls_last()).withColumn("weight", weight), "sources")
    limit = F.col("source_size") * F.lit(float(most))
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:
        over = F.lit(False) if capped < 0 else F.col("weight") * level > limit
        row = ranked.agg(
            F.count_if(over).alias("capped"),
            F.sum(F.when(over, limit)).alias("full"),
            F.sum(F.when(~over, F.col("weight"))).alias("open"),
        ).first()
        if row["capped"] == capped or not row["open"]:
            break
        capped, level = row["capped"], (total - (row["full"] or 0.0)) / row["open"]
    if not row["open"]:
        level = math.inf
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(level), limit)).drop("position", "weight")


def pivotal(size: np.ndarray, part: np.ndarray, random: np.random.Generator) -> int:
    """Round ``part`` in place, trading words; the index left fractional, or -1."""
    draws = random.random(len(part))
    open_at = -1
    for j in range(len(part)):
        if not 0.0 < part[j] < 1.0:
            continue
        if open_at < 0:
            open_at = j
            continue
        i = open_at
        a, b, p, q = size[i], size[j], part[i], part[j]
        up = min(a * (1 - p), b * q)  # words that j can give to i
        down = min(a * p, b * (1 - q))
        if draws[j] * (up + down) < down:
            p, q = (1.0, q - up / b) if up == a * (1 - p) else (p + up / a, 0.0)
        else:
            p, q = (0.0, q + down / b) if down == a * p else (p - down / a, 1.0)
        # What floating point leaves next to an end is at that end.
        part[i] = round(p) if abs(p - round(p)) < 1e-9 else p
        part[j] = round(q) if abs(q - round(q)) < 1e-9 else q
        open_at = next((k for k in (i, j) if 0.0 < part[k] < 1.0), -1)
    return open_at


def _rounder(seed: int, level: int, last: bool):
    def round_node(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id", "part"], ascending=[False, True, True], kind="stable")
        name = f"{seed}/{level}/{rows['source'].iloc[0]!r}/{rows['node'].iloc[0]}"
        random = np.random.Generator(np.random.PCG64(zlib.crc32(name.encode())))
        part = rows["part"].to_numpy(float).copy()
        part[rows["size"].to_numpy() == 0] = 0.0
        left = pivotal(rows["size"].to_numpy(float), part, random)
        if left >= 0 and last:
            part[left], left = float(random.random() < part[left]), -1
        rows["part"], rows["done"] = part, True
        if left >= 0:
            rows.iloc[left, rows.columns.get_loc("done")] = False
        return rows

    return round_node


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, size, source_size, target, copies, taken``.

    ``size`` counts words (null text: 0), ``taken`` is ``copies`` times it.  No
    document is taken more than ``most`` times, rounded up.  A null source is a
    source; repeated rows are rounded one by one; a source without words takes
    none.  The draws hang on seed, source and ids only, so reruns agree.
    """
    sized = kept(
        docs.select(
            F.col(id_col).cast("string").alias("doc_id"),  # pandas makes nullable ids doubles
            F.col(source_col).cast("string").alias("source"),
            F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("bigint").alias("size"),
        ),
        "sizes",
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    targets = kept(source_targets(sources, weights, share, most), "targets").withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + 1e-12)
    chunks = F.ceil(F.col("rows") / CHUNK_ROWS)
    # Rows alike in all that counts, which may be a third of a source, are counted
    # and numbered, so that they are dealt to as many nodes as others.
    again = F.sequence(F.lit(0).cast("bigint"), F.call_function("div", F.col("alike") - 1, F.lit(CHUNK_ROWS)))
    block = F.col("block") * CHUNK_ROWS
    copies = F.sequence(block, F.least(block + CHUNK_ROWS, F.col("alike")) - 1)
    sized = (
        sized.groupBy("doc_id", "source", "size")
        .agg(F.count("*").alias("alike"))
        .withColumn("block", F.explode(again))
        .withColumn("copy", F.explode(copies))
    )
    rows = sized.join(targets, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        whole.cast("bigint").alias("whole"),
        F.greatest(rate - whole, F.lit(0.0)).alias("part"),
        F.pmod(F.when(F.col("alike") == 1, F.xxhash64("doc_id", "size")).otherwise(F.xxhash64("doc_id", "size", "copy")), chunks).alias("node"),
        F.lit(False).alias("done"),
    )
    nodes = -(-(targets.agg(F.max("rows")).first()[0] or 1) // CHUNK_ROWS)
    level, settled = 0, None
    while True:
        last = nodes == 1
        after = kept(
            rows.groupBy("source", "node").applyInPandas(_rounder(seed, level, last), _MIXED), f"rounded-{level}"
        )
        done = after.filter("done")
        settled = done if settled is None else settled.union(done)
        if last:
            break
        rows = after.filter("not done").withColumn("node", F.expr(f"node div {FAN_IN}"))
        nodes, level = (nodes - 1) // FAN_IN + 1, level + 1
    copies = F.col("whole") + F.col("part").cast("bigint")
    return settled.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )
