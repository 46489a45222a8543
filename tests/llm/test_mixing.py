"""Mixing against targets worked out on the driver."""

import re
from collections import defaultdict

import numpy as np

from obsweave.llm import mixing, queries


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        open_weight = sum(weight[s] for s in names if s not in capped)
        out = {s: most * sizes[s] if s in capped else rest * weight[s] / open_weight for s in names}
        over = {s for s in names if out[s] > most * sizes[s]}
        if not over - capped:
            return out
        capped |= over


def check(rows, docs):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, text, source in docs:
        sizes[source] += size(text)
        longest[source] = max(longest[source], size(text))
    want = targets(sizes)
    assert sorted(((r.doc_id, r.size) for r in rows), key=str) == sorted(((i, size(t)) for i, t, _ in docs), key=str)
    for r in rows:
        assert abs(r.target - want[r.source]) <= 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source]
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.source] += r.taken
    for source, total in want.items():
        assert abs(taken[source] - total) <= longest[source] + 1e-6


def test_whole_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    read = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mix(read).collect()
    check(rows, docs)
    again = mixing.mix(read.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert queries.op4_mixing(spark, sf_dir).count() == len(docs)


def test_tree_and_odd_rows(frame, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 3)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    docs = [(i, "w " * (i % 7), f"s{i % 4}" if i % 5 else None) for i in range(120)]
    docs += [(None, "a b c", "s1"), (3, "a b", "s1"), (3, "a b", "s1"), (200, None, "empty"), (201, "", "empty")]
    check(mixing.mix(frame(docs)).collect(), docs)


def test_capped_source(frame):
    docs = [(1, "one", "a"), (2, "w " * 50, "b"), (3, "w " * 60, "c")]
    check(mixing.mix(frame(docs)).collect(), docs)


def test_empty_table(frame):
    assert mixing.mix(frame([])).collect() == []


def test_pivotal_keeps_expectations():
    """Each document's mean over many draws is its part, and words never change."""
    size, part = np.array([5.0, 3.0, 9.0, 2.0]), np.array([0.3, 0.6, 0.25, 0.8])
    total, runs = np.zeros(4), 4000
    for seed in range(runs):
        own = part.copy()
        mixing.pivotal(size, own, np.random.Generator(np.random.PCG64(seed)))
        assert abs((own * size).sum() - (part * size).sum()) < 1e-6
        assert sum(0 < p < 1 for p in own) <= 1
        total += own
    assert np.allclose(total / runs, part, atol=0.03)
