"""Approximate nearest neighbours by cosine over robust-pruned directed graphs.

Distinct vectors are dealt into shards of a bounded size.  In each, points are
inserted in batches that double: a greedy beam search over the graph so far
proposes neighbours, relaxed distance pruning keeps near ones that lie in
different directions, and back edges are pruned alike.  The graphs are stored.
A search walks every shard's graph with a beam, block of queries by block, and
scores what it found on the original vectors in double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obsweave.llm.common import kept

SHARD_ROWS = 5_000  # points of one graph
QUERY_BLOCK = 2_000  # query vectors one task searches a shard for
DEGREE = 24
BEAM = 64  # of a walk that proposes neighbours
SEARCH_BEAM = 96  # of a walk that answers
RELAX = 1.2  # how much farther an edge may be than a detour
ENTRIES = 16  # points a walk starts from
BATCH = 128


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, scaled first, as squares may overflow.

    In double precision: distances inside a group of near copies are far below
    what single precision tells apart.
    """
    wide = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def beam_search(
    points: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray]:
    """Nearest first, for each query the ``beam`` best points met and their distances (-1 and inf pad).

    All queries take their steps together: each expands its nearest point not
    expanded yet, until its whole beam is.
    """
    n, rows = len(queries), np.arange(len(queries))[:, None]
    seen = np.zeros((n, len(points)), bool)
    seen[:, entries] = True
    ids = np.full((n, beam), -1, np.int64)
    far = np.full((n, beam), np.inf)
    done = np.ones((n, beam), bool)
    first = 2 - 2 * queries @ points[entries].T
    order = np.argsort(first, axis=1, kind="stable")[:, :beam]
    width = order.shape[1]
    ids[:, :width], far[:, :width], done[:, :width] = entries[order], np.take_along_axis(first, order, 1), False
    live = np.arange(n)
    while len(live):
        at = np.argmin(done[live], axis=1)
        live, at = live[~done[live, at]], at[~done[live, at]]
        if not len(live):
            break
        done[live, at] = True
        near = graph[ids[live, at]]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        seen[live[:, None], np.where(fresh, near, ids[live, at][:, None])] = True
        reach = 2 - 2 * np.einsum("ijk,ik->ij", points[near], queries[live])
        reach[~fresh] = np.inf
        all_far = np.concatenate([far[live], reach], axis=1)
        order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        ids[live] = np.take_along_axis(np.concatenate([ids[live], near], axis=1), order, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], axis=1), order, 1)
        far[live] = np.take_along_axis(all_far, order, 1)
    ids[~np.isfinite(far)] = -1
    return ids, far


def robust_prune(points: np.ndarray, own: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Up to ``DEGREE`` neighbours for each point of ``own`` from its row of candidates (-1 pads).

    The nearest stays; whatever is nearer to it, by ``RELAX``, than to the point
    goes; and so on with the rest.
    """
    vectors = points[candidates]
    far = 2 - 2 * np.einsum("ijk,ik->ij", vectors, points[own])
    far[(candidates < 0) | (candidates == own[:, None])] = np.inf
    order = np.argsort(far, axis=1, kind="stable")
    far, candidates = np.take_along_axis(far, order, 1), np.take_along_axis(candidates, order, 1)
    vectors = points[candidates]
    between = 2 - 2 * np.einsum("ijk,ilk->ijl", vectors, vectors)
    alive = np.isfinite(far)
    out = np.full((len(own), DEGREE), -1, np.int64)
    rows = np.arange(len(own))
    for place in range(DEGREE):
        pick = np.argmax(alive, axis=1)
        ok = alive[rows, pick]
        if not ok.any():
            break
        out[ok, place] = candidates[rows, pick][ok]
        alive &= RELAX * between[rows, pick] > far
        alive[rows, pick] = False
        alive[candidates == out[:, place][:, None]] = False
    return out


def build(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Graph (neighbours of each point, -1 pads) and entry points."""
    n = len(points)
    order = np.random.Generator(np.random.PCG64(n)).permutation(n)
    graph = np.full((n, DEGREE), -1, np.int64)
    at = min(n, ENTRIES)
    entries = order[:at].copy()
    first = np.broadcast_to(entries, (at, at)).copy()
    graph[entries] = robust_prune(points, entries, first)
    while at < n:
        batch = order[at : at + min(BATCH, at)]
        at += len(batch)
        found, _ = beam_search(points, graph, entries, points[batch], BEAM)
        # Points of one batch do not see each other in the graph; let the nearest ones meet.
        mutual = batch[np.argsort(-(points[batch] @ points[batch].T), axis=1, kind="stable")[:, : DEGREE // 2]]
        graph[batch] = robust_prune(points, batch, np.concatenate([found, mutual], axis=1))
        target, source = graph[batch].ravel(), np.repeat(batch, DEGREE)
        target, source = target[target >= 0], source[target >= 0]
        by = np.argsort(target, kind="stable")
        target, source = target[by], source[by]
        touched, starts = np.unique(target, return_index=True)
        place = np.arange(len(target)) - np.repeat(starts, np.diff(np.r_[starts, len(target)]))
        back = np.full((len(touched), place.max(initial=-1) + 1), -1, np.int64)
        back[np.repeat(np.arange(len(touched)), np.diff(np.r_[starts, len(target)])), place] = source
        for part in range(0, len(touched), 4 * BATCH):
            own = touched[part : part + 4 * BATCH]
            graph[own] = robust_prune(points, own, np.concatenate([graph[own], back[part : part + 4 * BATCH]], axis=1))
    return graph, entries


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, vector`` of the rows that take part."""
    parts = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return parts.filter(F.col("vec_id").isNotNull() & fine & F.exists("vector", lambda x: x != 0))


def distinct_points(rows: DataFrame, most: int) -> DataFrame:
    """``point, dims, vector, ids`` of each distinct vector: its ``most`` least ids, the first as name.

    Ids beyond those can be in no result, so a vector that a third of the rows
    share is one point, cut down before the shuffle.
    """
    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    least = rows.distinct().withColumn("place", place).filter(F.col("place") <= most)
    return (
        least.groupBy("vector")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .select(F.get("ids", F.lit(0)).alias("point"), F.size("vector").alias("dims"), "vector", "ids")
    )


def build_index(points: DataFrame) -> tuple[DataFrame, int]:
    """The stored graphs, a row a point, and the number of shards."""
    shards = -(-max(points.count(), 1) // SHARD_ROWS)

    def graphs(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("point", ignore_index=True)
        graph, entries = build(unit(np.array(rows["vector"].tolist(), np.float64)))
        rows["place"], rows["near"] = np.arange(len(rows)), list(graph.astype(np.int32))
        rows["entry"] = np.isin(rows["place"], entries)
        return rows[["dims", "shard", "point", "place", "vector", "near", "entry"]]

    dealt = points.withColumn("shard", F.pmod(F.xxhash64("point"), F.lit(shards)).cast("int"))
    vector = dealt.schema["vector"].dataType.simpleString()
    schema = f"dims int, shard int, point bigint, place int, vector {vector}, near array<int>, entry boolean"
    dealt = dealt.select("dims", "shard", "point", "vector")
    return kept(dealt.groupBy("dims", "shard").applyInPandas(graphs, schema), "graphs"), shards


def search(index: DataFrame, shards: int, queries: DataFrame, most: int) -> DataFrame:
    """``query, point, score``: up to ``most`` points of each shard for each query point."""
    blocks = -(-max(queries.count(), 1) // QUERY_BLOCK)

    def walk(key: tuple, graph: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = {"query": [], "point": [], "score": []}
        if len(graph) and len(asked):
            graph = graph.sort_values("place", ignore_index=True)
            vectors = np.array(graph["vector"].tolist(), np.float64)
            names, near = graph["point"].to_numpy(), np.array(graph["near"].tolist(), np.int64)
            entries, points = np.flatnonzero(graph["entry"]), unit(vectors)
            vectors /= np.abs(vectors).max(axis=1, keepdims=True)
            for at in range(0, len(asked), 256):
                part = asked.iloc[at : at + 256]
                own = np.array(part["vector"].tolist(), np.float64)
                ids, _ = beam_search(points, near, entries, unit(own), max(SEARCH_BEAM, most))
                own /= np.abs(own).max(axis=1, keepdims=True)
                dots = np.einsum("ijk,ik->ij", vectors[ids], own)
                score = dots / (np.linalg.norm(vectors[ids], axis=2) * np.linalg.norm(own, axis=1)[:, None])
                score[ids < 0] = -np.inf
                order = np.lexsort((names[ids], -score), axis=1)[:, :most]
                score = np.take_along_axis(score, order, 1)
                named = np.take_along_axis(names[ids], order, 1)
                real = np.isfinite(score)
                found["query"].append(np.repeat(part["query"].to_numpy(), real.sum(axis=1)))
                found["point"].append(named[real])
                found["score"].append(score[real])
        return pd.DataFrame({c: np.concatenate(v) if v else [] for c, v in found.items()})

    replicated = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = (
        queries.select(F.col("point").alias("query"), "dims", "vector")
        .withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    )
    key = ["dims", "shard", "block"]
    return (
        replicated.groupBy(*key)
        .cogroup(asked.groupBy(*key))
        .applyInPandas(walk, "query bigint, point bigint, score double")
    )


def nearest(
    vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for each row that ``is_query`` takes.

    ``is_query`` is a condition on ``vec_id``.  Score is the cosine; ties go to
    the smaller id.  Rows without id, and vectors null, zero or with a component
    null or not finite, take no part; vectors of other lengths never meet.  Rows
    of one id are one candidate, at its best score, and never their own.  Fewer
    than ``k`` candidates are all returned; an empty table gives no rows.
    """
    rows = kept(usable(vectors, id_col, vector_col), "vectors")
    points = kept(distinct_points(rows, k + 1), "points")
    index, shards = build_index(points)
    asked = rows.filter(is_query).distinct()
    # Equal query vectors are searched for once.
    names = points.select("point", "dims", "vector")
    queries = kept(asked.join(names, "vector"), "queries")
    found = kept(search(index, shards, queries.select("point", "dims", "vector").distinct(), k + 1), "found")

    best = Window.partitionBy("query").orderBy(F.desc("score"), "point")
    top = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)
    ids = top.join(points.select("point", "ids"), "point").select("query", "score", F.explode("ids").alias("vec_id"))
    lists = ids.groupBy("query").agg(F.collect_list(F.struct("vec_id", "score")).alias("near"))  # (k + 1) ** 2 at most
    pairs = (
        queries.select(F.col("vec_id").alias("query_id"), F.col("point").alias("query"))
        .join(lists, "query")
        .select("query_id", F.inline("near"))
        .filter("query_id <> vec_id")
        .groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
