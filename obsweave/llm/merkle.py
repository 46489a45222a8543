"""Merkle manifest of a dataset: a digest of everything, and a proof for each row.

Every row is a leaf.  Leaves lie in groups, ordered within; runs of ``WIDTH``
consecutive nodes are hashed to their parent until one node of a group remains,
its subroot; the subroots, ordered, give the root the same way.  All digests are
SHA-256, and what is hashed is the concatenation of hex digests.

On each level one window over blocks of whole runs supplies, by fixed-offset lag
and lead columns masked by slot and run length, the siblings of every node, and
the first child of a run hashes the parent.  No window spans a group: places
come from ``ranking.with_position``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsweave.llm.common import kept
from obsweave.operators.ranking import small, with_position

WIDTH = 8
BLOCK = WIDTH**2  # nodes that a window orders at once, 8 runs
GROUPS = 10_000  # whose facts are broadcast; with more groups a join deals the rows by them

NOTHING = bytearray()


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def hashed(digests: Column) -> Column:
    """The digest of digests laid end to end, read as lower-case hex."""
    return F.unhex(F.sha2(F.lower(F.hex(digests)), 256))


def hex_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf(values: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[encoded(v) for v in values]), 256))


def _div(value: Column, width: int) -> Column:
    """Whole multiples of ``width`` in a number that is not negative."""
    return F.floor(value / F.lit(width)).cast("bigint")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Nodes (``grp, total, position, digest`` and others) with the digests to the ``left`` and ``right`` in their run."""
    slot = F.pmod("position", F.lit(WIDTH).cast("bigint"))
    length = F.least(F.lit(WIDTH), F.col("total") - F.col("position") + slot)
    blocks = Window.partitionBy("grp", _div(F.col("position"), BLOCK)).orderBy("position")
    left = [
        F.when(slot >= k, F.lag("digest", k).over(blocks)).otherwise(F.lit(NOTHING)) for k in range(WIDTH - 1, 0, -1)
    ]
    right = [F.when(slot + k < length, F.lead("digest", k).over(blocks)).otherwise(F.lit(NOTHING)) for k in range(1, WIDTH)]
    return nodes.select("*", F.concat(*left).alias("left"), F.concat(*right).alias("right"))


def parents(nodes: DataFrame) -> DataFrame:
    """The next level up: the first child of each run hashes it."""
    return (
        with_siblings(nodes.select("grp", "total", "position", "digest"))
        .where(F.pmod("position", F.lit(WIDTH).cast("bigint")) == 0)
        .select(
            "grp",
            _div(F.col("total") + (WIDTH - 1), WIDTH).alias("total"),
            _div(F.col("position"), WIDTH).alias("position"),
            hashed(F.concat("digest", "right")).alias("digest"),
        )
    )


def levels(leaves: DataFrame) -> list[DataFrame]:
    """The levels of all groups' trees from the leaves up, each stored.

    A group takes part up to the level on which one node of it remains.  The
    driver learns the size of the largest group only.
    """
    found = [leaves]
    largest = leaves.agg(F.max("total")).first()[0] or 0
    while largest > 1:
        found.append(kept(parents(found[-1].where("total > 1")), "merkle-level"))
        largest = -(-largest // WIDTH)
    return found


def subroots(found: Sequence[DataFrame]) -> DataFrame:
    """``grp, digest`` of the one node that remains of each group."""
    tops = [level.where("total = 1").select("grp", "digest") for level in found]
    result = tops[0]
    for top in tops[1:]:
        result = result.unionByName(top)
    return result


def with_paths(found: Sequence[DataFrame]) -> DataFrame:
    """The leaves with ``path``: for each level up to the subroot what lies left and right in the run."""
    path = None
    for level in reversed(found):
        step = F.array(F.struct("left", "right"))
        own = F.when(F.col("total") > 1, step).otherwise(F.slice(step, 1, 0))
        nodes = with_siblings(level).withColumn("path", own).drop("left", "right")
        if path is not None:
            above = path.select(
                F.col("grp").alias("up_grp"), F.col("position").alias("up_position"), F.col("path").alias("up_path")
            )
            up = (F.col("grp") == F.col("up_grp")) & (_div(F.col("position"), WIDTH) == F.col("up_position"))
            nodes = (
                nodes.join(above, up & (F.col("total") > 1), "left")
                .withColumn("path", F.concat("path", F.coalesce("up_path", F.slice("path", 1, 0))))
                .drop("up_grp", "up_position", "up_path")
            )
        path = nodes
    return path


def fold(claim: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings on its way up."""
    return F.aggregate(path, claim, lambda below, step: hashed(F.concat(step["left"], below, step["right"])))


def proof_digests(path: Column) -> Column:
    """All siblings of a path end to end, level by level, left to right."""
    return F.aggregate(path, F.lit(NOTHING), lambda done, step: F.concat(done, step["left"], step["right"]))


def _placed(nodes: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Nodes with ``position`` and ``total`` within their group."""
    placed = with_position(nodes, order, within=["grp"])
    totals = placed.groupBy(F.col("grp").alias("of_grp")).agg(F.count(F.lit(1)).alias("total"))
    return placed.join(small(totals, "merkle-totals", GROUPS), F.col("grp") == F.col("of_grp")).drop("of_grp")


def manifest(
    docs: DataFrame,
    fields: Sequence[str],
    group: str,
    id_col: str,
    received: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``id, leaf, subroot, root, path, folded_root, verified``.

    A leaf is the digest of ``fields``; within a ``group`` leaves ascend by
    ``id_col``, groups by value, null first.  ``received`` gives fields as they
    came back: ``folded_root`` is the root that follows from the leaf of these
    and the original siblings on ``path``, and ``verified`` says whether it is
    the root.  Digests are binary.

    A null id comes first; rows of one id are ordered by their leaves, and rows
    equal in all fields are interchangeable.  Null fields and empty texts have
    encodings of their own.  A single row is leaf, subroot and root at once, with
    an empty path; without rows there is no result row.  Columns that are not
    named are not read, so their names do not matter.
    """
    changed = {**{f: F.col(f) for f in fields}, **(received or {})}
    rows = docs.select(
        F.col(id_col).alias("id"),
        encoded(F.col(group)).alias("grp"),
        leaf([F.col(f) for f in fields]).alias("digest"),
        leaf([changed[f] for f in fields]).alias("claim"),
    )
    leaves = kept(_placed(rows, [F.col("id").asc_nulls_first(), F.col("digest")]), "merkle-leaves")
    found = levels(leaves)

    # The tree over the subroots: one group, ordered by the value of theirs.
    after = F.expr("substring(of, position(':' IN of) + 1)")
    value = F.when(F.col("of") != "-", after)
    tops = subroots(found).select(F.lit("").alias("grp"), F.col("grp").alias("of"), "digest")
    tops = kept(_placed(tops, [value.asc_nulls_first()]), "merkle-subroots")
    upper = levels(tops)
    root = subroots(upper).select(F.col("grp"), F.col("digest").alias("root"))  # one row
    tops = with_paths(upper).select("grp", "of", F.col("digest").alias("subroot"), F.col("path").alias("top_path"))
    tops = small(tops.join(F.broadcast(root), "grp").drop("grp"), "merkle-tops", GROUPS)

    path = F.concat("path", "top_path")
    return (
        with_paths(found)
        .join(tops, F.col("grp") == F.col("of"))
        .select("id", F.col("digest").alias("leaf"), "claim", "subroot", "root", path.alias("path"))
        .withColumn("folded_root", fold(F.col("claim"), F.col("path")))
        .withColumn("verified", F.col("folded_root") == F.col("root"))
        .drop("claim")
    )
