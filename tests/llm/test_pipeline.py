"""Each stage against a brute-force version of it, on what its predecessor kept."""

import math
import re
from collections import Counter, defaultdict

import corpus_pipeline
import test_mixing
import test_ngram_join
import test_packing
from pyspark.sql import functions as F

from obsweave.llm import quality

COLUMNS = list(corpus_pipeline.COLUMNS)


def odds(p):
    return math.log(p / (1 - p))


def good(docs, model):
    """Ids that the classifier keeps, worked out without Spark."""
    scores = model.evidence([d["text"] or "" for d in docs])
    rates, paths, hosts = [1 / (1 + math.exp(-s)) for s in scores], defaultdict(list), defaultdict(list)
    for d, r in zip(docs, rates):
        paths[d["source"], d["lang"]].append(r)
    overall = (sum(rates) + 0.5) / (len(rates) + 1)

    def strength(groups):  # (rows, good, prior)
        rows = sum(g[0] for g in groups)
        chance = sum(n * p * (1 - p) for n, _, p in groups) / rows
        between = (sum(n * (s / n - p) ** 2 for n, s, p in groups) - len(groups) * chance) / rows
        return min(max(chance / between - 1 if between > 0 else 1e6, 1.0), 1e6)

    for (host, _), found in paths.items():
        hosts[host] += found
    k = strength([(len(v), sum(v), overall) for v in hosts.values()])
    host_rate = {h: (sum(v) + k * overall) / (len(v) + k) for h, v in hosts.items()}
    k = strength([(len(v), sum(v), host_rate[h]) for (h, _), v in paths.items()])
    shift = {p: odds((sum(v) + k * host_rate[p[0]]) / (len(v) + k)) - odds(overall) for p, v in paths.items()}
    return {d["doc_id"] for d, s in zip(docs, scores) if s + shift[d["source"], d["lang"]] >= 0}


def without_repeats(docs):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for d in docs:
        for line in (d["text"] or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(d["doc_id"])
    last = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    return {
        d["doc_id"]: "\n".join(x for x in (d["text"] or "").split("\n") if last.get(key(x), d["doc_id"]) == d["doc_id"])
        for d in docs
    }


def rows(frame):
    return [r.asDict() for r in frame.collect()]


def test_stages(spark, sf_dir):
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == [
        "good_documents", "fresh_lines", "distinct_documents", "mixed_documents", "packed_documents"
    ]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    outs = [docs]
    for place, (_, stage) in enumerate(corpus_pipeline.STAGES):
        outs.append(corpus_pipeline.kept(stage(spark, outs[-1], sf_dir), f"test-{place}"))
    for out in outs[:-1]:
        assert out.columns == COLUMNS and dict(out.dtypes) == dict(docs.dtypes)
    raw, chosen, fresh, single, mixed = map(rows, outs[:-1])

    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert {d["doc_id"] for d in chosen} == good(raw, model)
    assert {d["doc_id"]: d["text"] for d in fresh} == without_repeats(chosen)
    assert all(d["n_chars"] == len(d["text"]) for d in fresh)

    component = test_ngram_join.brute([(d["doc_id"], d["text"]) for d in fresh], 5, 80)
    assert sorted(d["doc_id"] for d in single) == sorted(i for i, (_, root) in component.items() if i == root)

    sizes = {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"])) for d in single}
    by_source, longest = defaultdict(int), defaultdict(int)
    for d in single:
        by_source[d["source"]] += sizes[d["doc_id"]]
        longest[d["source"]] = max(longest[d["source"]], sizes[d["doc_id"]])
    want, taken = test_mixing.targets(by_source), Counter()
    for d in mixed:
        taken[d["source"]] += sizes[d["doc_id"]]
    assert all(abs(taken[s] - t) <= longest[s] + 1e-6 for s, t in want.items())
    assert max(Counter(d["doc_id"] for d in mixed).values()) <= 2
    assert {(d["doc_id"], d["text"]) for d in mixed} <= {(d["doc_id"], d["text"]) for d in single}

    used = test_packing.check(outs[-1].collect(), [(d["doc_id"], d["text"]) for d in mixed], 4096)
    assert used <= 1.02 * -(-outs[-1].agg(F.sum("length")).first()[0] // 4096) + 1


def test_odd_rows_through_every_stage(spark, sf_dir):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, key string, copies string"
    odd = [(1, None, None, None, None), (None, "no id but text", "en", "s", 1), (None, None, "en", None, 0), (2, "same", "en", "s", 4), (2, "same", "en", "s", 4)]
    odd += [(3, "word " * 30000, "en", "s", 150000), (-4, "", "en", "t", 0)]
    frame = spark.createDataFrame([(*r, None, "clash", "clash") for r in odd], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame.limit(0), sf_dir).collect() == []
        stage(spark, frame, sf_dir).collect()
    assert corpus_pipeline.distinct_documents(spark, frame, sf_dir).filter("doc_id = 2").count() == 1
    assert corpus_pipeline.fresh_lines(spark, frame, sf_dir).count() == len(odd)


def test_unrelated_texts_of_one_id_stay(spark, sf_dir):
    text = "a story of seven words and more words"
    found = [(7, text, "en", "b", 1), (7, text, "en", "a", 1), (7, "quite another text that shares nothing at all", "en", "a", 1), (9, text, "en", "a", 1)]
    frame = spark.createDataFrame(found, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    rows = sorted(map(tuple, corpus_pipeline.distinct_documents(spark, frame, sf_dir).collect()))
    assert rows == sorted(found[1:3])
