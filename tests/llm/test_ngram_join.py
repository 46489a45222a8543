"""The join against every pair."""

import random
import re

import numpy as np
import pytest

from obsweave.llm import components as stars
from obsweave.llm import ngram_join, queries, wordhash
from obsweave.llm.components import components


def brute(docs, width, percent):
    """id -> (size, component) from all pairs of documents."""
    sets = {}
    for doc_id, text in docs:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        n = min(width, len(words))
        sets[doc_id] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    holders = {}
    for i in ids:
        for t in sets[i]:
            holders.setdefault(t, []).append(i)
    seen = set()
    for group in holders.values():
        for x, a in enumerate(group):
            for b in group[x + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in ids}


def got(rows):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def test_whole_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op10_ngram_join(spark, sf_dir).collect()
    assert len(rows) == len(docs) and got(rows) == brute(docs, 4, 85)


@pytest.mark.parametrize("seed", range(3))
def test_near_copies_with_frequent_tokens(frame, monkeypatch, seed):
    """A low bar for frequent makes most tokens frequent, so keys are mostly pairs."""
    monkeypatch.setattr(ngram_join, "FREQUENT", 3)
    draw = random.Random(seed)
    word = lambda: f"w{draw.randint(0, 400)}"
    docs, passage = [], [word() for _ in range(15)]
    for base in range(12):
        text = [word() for _ in range(draw.choice([3, 6, 12, 30, 60, 120]))]
        if base % 3 == 0:
            text += passage
        for _ in range(draw.choice([1, 2, 14])):
            own = list(text)
            for _ in range(draw.randint(0, 1 + len(own) // 25)):
                own[draw.randrange(len(own))] = word()
            docs.append((len(docs), " ".join(own)))
    docs += [(900, passage and " ".join(passage)), (901, "a"), (902, "A"), (903, "a b"), (904, ""), (905, None), (906, " \t")]
    similar = ngram_join.Similarity(4, 85)
    assert got(ngram_join.join_components(frame(docs), similar).collect()) == brute(docs, 4, 85)
    similar = ngram_join.Similarity()
    assert got(ngram_join.join_components(frame(docs), similar).collect()) == brute(docs, 5, 80)


def template_pages(n, seed=1):
    """Pages of one template of 200 words, each with three of 30 stock phrases in it."""
    draw = random.Random(seed)
    template = [f"t{i}" for i in range(200)]
    phrases = [[f"p{i}w{j}" for j in range(8)] for i in range(30)]
    docs = []
    for i in range(n):
        chosen = [w for p in draw.sample(range(30), 3) for w in phrases[p]]
        docs.append((i, " ".join(template[:100] + chosen + template[100:])))
    return docs


def test_near_misses_of_a_template(frame, monkeypatch):
    """Compared pairs grow with the documents, not with their square; the links are those of all pairs."""
    compared, real = [], ngram_join._compared

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(ngram_join, "_compared", counted)
    for n in (300, 600):
        docs, before = template_pages(n), sum(compared)
        found = got(ngram_join.join_components(frame(docs), ngram_join.Similarity()).collect())
        assert found == brute(docs, 5, 80)
        assert sum(compared) - before <= 8 * n


def test_keys_of_long_texts():
    """As many as the text is long, whatever part of its tokens is frequent; sets that link share one."""
    similar, draw = ngram_join.Similarity(), np.random.Generator(np.random.PCG64(4))
    for size in (50_000, 200_000):
        tokens = np.unique(draw.integers(0, 2**63, size).astype(np.uint64))
        keys, most = ngram_join.index_keys(tokens, np.ones(len(tokens), bool), similar)
        assert len(keys) == len(most) <= 20 * size
    for size in (30, 200, 3_000, 4_090, 5_000, 20_000):
        for often in (0.0, 0.5, 1.0):
            for _ in range(20):
                union = np.unique(draw.integers(0, 2**63, size).astype(np.uint64))
                is_frequent = draw.random(len(union)) < often
                # Rare ones first, as all documents order them.
                union = np.concatenate([union[~is_frequent], union[is_frequent]])
                is_frequent = np.sort(is_frequent)
                owner = np.zeros(len(union), int)  # 0: both, 1: first only, 2: second only
                lost = draw.choice(len(union), len(union) // 5, replace=False)
                owner[lost] = draw.choice([1, 2], len(lost), p=draw.choice([[0.5, 0.5], [0.05, 0.95], [1, 0]]))
                found = []
                for other in (2, 1):
                    own = owner != other
                    found.append(set(ngram_join.index_keys(union[own], is_frequent[own], similar)[0].tolist()))
                assert found[0] & found[1], (size, often)


def test_odd_rows(frame):
    text = "one two three four five six"
    docs = [(5, text), (5, text), (None, text), (None, "alone and without an id here"), (7, text + " "), (None, None), (-3, text.upper())]
    docs += [(8, "long " * 30000), (9, "long " * 40000)]
    rows = ngram_join.join_components(frame(docs), ngram_join.Similarity(4, 85)).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows if r.doc_id is not None) == [
        (-3, -3), (5, -3), (5, -3), (7, -3), (8, 8), (9, 8)
    ]
    assert sorted((r.n_shingles, r.component_id or 0) for r in rows if r.doc_id is None) == [(0, 0), (3, -3), (3, 0)]
    assert sum(r.first for r in rows) == 4
    assert ngram_join.join_components(frame([])).collect() == []


def test_meetings_of_a_hot_key(spark):
    """No Python and no sort of whole partitions; one row of a set speaks for it."""
    rows = [(i, True, 9, i % 5 + 1, i, i, [7, 100 + i, 200 + i // 2], [9, 8, 7], i) for i in range(60)]
    rows += [(0, True, 9, 1, 0, 0, [7, 100, 200], [9, 8, 7], 60 + i) for i in range(5)]
    schema = "id bigint, named boolean, size int, rare int, s1 bigint, s2 bigint, keys array<bigint>, most array<int>, row bigint"
    nodes = spark.createDataFrame([(i,) for i in range(60)], "row bigint")
    met = ngram_join._meetings(spark.createDataFrame(rows, schema), nodes)
    plan = met._jdf.queryExecution().toString()
    assert "InPandas" not in plan and "Window" not in plan
    found = met.collect()
    assert sorted((r.key, r.node) for r in found) == sorted([(7, i) for i in range(60)] + [(200 + i // 2, i) for i in range(60)])
    centre = {r.key: r.centre for r in found}
    assert len({(r.key, r.centre) for r in found}) == len(centre) == 31 and centre[7] % 5 == 0
    assert all(centre[200 + i // 2] == min((i // 2 * 2, i // 2 * 2 + 1), key=lambda n: n % 5) for i in range(60))
    assert all((r.size, r.centre_size, r.centre_most) == (9, 9, 9 if r.key == 7 else 7) for r in found)


def test_components(spark):
    draw = random.Random(3)
    links = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1040)]
    root = {i: i for pair in links for i in pair}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    rows = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r.node: r.root for r in rows} == {i: find(i) for i in root if find(i) != i}


@pytest.fixture
def many_partitions(spark):
    """Small exchanges are dealt over many tasks, and nothing gathers them."""
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in held}
    for name, value in held.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def test_few_rounds_of_few_tasks(spark, monkeypatch, many_partitions):
    """Stars are found settled without a round; what is small is not dealt over all shuffle partitions."""
    stored, real = [], stars.kept

    def counted(frame, label, *rest):
        out = real(frame, label, *rest)
        stored.append((label, len(out.inputFiles())))
        return out

    monkeypatch.setattr(stars, "kept", counted)
    links = [(i, i % 50) for i in range(50, 2000)] * 2
    rows = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert sorted((r.node, r.root) for r in rows) == sorted(set(links))
    assert "stars" not in [label for label, _ in stored]
    rows = components(spark.createDataFrame([(i, i - 7) for i in range(7, 700)], "a bigint, b bigint")).collect()
    assert sorted((r.node, r.root) for r in rows) == [(i, i % 7) for i in range(7, 700)]
    assert "stars" in [label for label, _ in stored]
    assert max(files for _, files in stored) <= spark.sparkContext.defaultParallelism


def test_split_keys_without_those_that_link_to_nobody(spark):
    """Of keys that several components have, only postings are left that are enough for some other."""
    similar = ngram_join.Similarity(4, 85)
    # Sets of 100 link with 92 shared tokens at least, here with all that precede none.
    met = [(7, i, 100, most, 0, 100, 100) for i, most in enumerate((100, 95, 92, 91, -99, -60))]
    # One of 90 there needs 88 only.
    met += [(8, i, size, most, 0, 100, 100) for i, size, most in ((0, 100, 100), (1, 90, 90), (2, 100, 88), (3, 100, 87))]
    met += [(9, i, 100, 100, 4, 100, 100) for i in (4, 5)]
    met = spark.createDataFrame(met, "key bigint, node bigint, size int, most int, centre bigint, centre_size int, centre_most int")
    compared = spark.createDataFrame([], "a bigint, b bigint, links boolean, shared int, outside int")
    roots = spark.createDataFrame([(5, 4)], "node bigint, root bigint")
    left = ngram_join._split_keys(met, compared, roots, similar).collect()
    assert sorted((r.key, r.node) for r in left) == [(7, 0), (7, 1), (7, 2), (7, 4), (8, 0), (8, 1), (8, 2)]


def test_word_hashes(monkeypatch):
    texts = ["", "  a b\n\tA  c ", "é É a", "x" * 50 + " y", "a b a c"]
    words = {}
    for slice_size in (1 << 20, 8):
        monkeypatch.setattr(wordhash, "SLICE", slice_size)
        for text, hashes in zip(texts, wordhash.words(texts)):
            lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
            assert len(lowered) == len(hashes)
            for w, h in zip(lowered, hashes):
                assert words.setdefault(w, h) == h
    assert len(set(map(int, words.values()))) == len(words)
    assert len(wordhash.shingle_set(np.array([1, 2, 1, 2, 1], np.uint64), 2)) == 2
