"""Connected components by alternating stars, with nothing gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsweave.llm.common import ROWS_A_FILE, few_tasks, kept


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    across = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return across.union(least.select("u", F.col("m").alias("v")))


def _settled(edges: DataFrame) -> bool:
    """Whether each ``u`` has one ``v`` and no ``v`` is a ``u``: then every component is a star."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("to")).union(
        edges.select(F.col("v").alias("node"), F.lit(None).cast("bigint").alias("to"))
    )
    nodes = ends.groupBy("node").agg(
        F.min("to").alias("low"), F.max("to").alias("high"), F.count_if(F.col("to").isNull()).alias("under")
    )
    return nodes.filter("low is not null and (low < high or under > 0)").agg(F.count("*")).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every linked node that is not the least of its component.

    ``links`` has two bigint columns.  Each round joins every edge to the least
    neighbour of its ends, until all edges are stars around their least node: then
    each points at the root.  Rounds are stored, so a lost executor costs part of
    one round, and never have more edges than links, so tasks are as many as these need.
    """
    a, b = links.columns
    links = kept(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v"), "links")
    count = links.count()
    edges = kept(links.distinct(), "edges", count)
    while not _settled(edges):
        large = kept(_large_star(edges), "large-stars", count)
        edges = kept(few_tasks(_small_star(large), count, ROWS_A_FILE).distinct(), "stars", count)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
