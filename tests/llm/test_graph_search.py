"""Search against every pair."""

import math

import numpy as np
from pyspark.sql import functions as F

from obsweave.llm import graph_search, queries

SCHEMA = "vec_id bigint, embedding array<float>, score string, shard string"


def brute(rows, is_query, k):
    fine = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in fine:
        if is_query(q):
            scores = [(-float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), i) for i, b in fine if i != q and len(a) == len(b)]
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def answers(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_on_whole_table(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(graph_search, "SHARD_ROWS", 200)
    monkeypatch.setattr(graph_search, "QUERY_BLOCK", 4)
    table = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, got = brute(table, lambda i: i % 50 == 0, 5), answers(queries.op6_graph_search(spark, sf_dir).collect())
    assert set(want) == set(got) and all(len(got[q]) == 5 for q in got)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    scores = dict(table)
    for q, near in got.items():
        a = np.array(scores[q], np.float64)
        for i, s in near:
            b = np.array(scores[i], np.float64)
            assert abs(s - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def test_recall_of_one_graph():
    """Clusters far apart and thousands of near copies of one vector."""
    draw = np.random.Generator(np.random.PCG64(5))
    centres = draw.normal(size=(12, 32)) * 4
    points = np.concatenate([centres[draw.integers(0, 12, 1500)] + draw.normal(size=(1500, 32)), centres[:1] + 1e-3 * draw.normal(size=(1500, 32))])
    points = graph_search.unit(points)
    graph, entries = graph_search.build(points)
    asked = points[::30]
    found, _ = graph_search.beam_search(points, graph, entries, asked, graph_search.SEARCH_BEAM)
    true = np.argsort(-(asked.astype(float) @ points.astype(float).T), axis=1)[:, :6]
    assert np.mean([len(set(t) & set(f[:6])) / 6 for t, f in zip(true, found)]) > 0.9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 0.0]), (5, [1.0, 0.0]), (6, [1.0, 0.0]),
        (7, [2.0, 0.0]), (10, [0.0, 1.0]), (20, [3e38, 3e38]), (30, None), (40, []), (50, [0.0, 0.0]), (60, [nan, 1.0]),
        (70, [inf, 1.0]), (80, [None, 1.0]), (90, [1.0, 2.0, 3.0]), (100, [1.0, 2.0, 3.5]), (None, [1.0, 1.0]), (10, [0.0, 1.0]),
    ]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = answers(graph_search.nearest(frame, F.col("vec_id") % 10 == 0, k=5).collect())
    want = brute([r for i, r in enumerate(rows) if r not in rows[:i]], lambda i: i % 10 == 0, 5)
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q
        assert all(abs(a - b) < 1e-12 for (_, a), (_, b) in zip(got[q], want[q]))
    assert graph_search.nearest(frame.limit(0), F.col("vec_id") % 10 == 0).collect() == []
