"""The classifier on labels it has not seen, and the shrinkage by hand."""

import numpy as np

from obsweave.llm import quality, queries


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.fit(docs, labels.filter("doc_id % 4 <> 0"))
    good = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in labels.filter("doc_id % 4 = 0").collect()}
    kept = {r.doc_id: r.kept for r in quality.classify(docs, model).select("doc_id", "kept").collect()}
    right = np.mean([kept[i] == g for i, g in good.items()])
    assert right > 0.93
    assert np.mean([kept[i] for i, g in good.items() if g]) > 0.97


def test_query(spark, sf_dir):
    rows = queries.op8_quality_classifier(spark, sf_dir).collect()
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert 0.5 * n < len(rows) < n and all(r.kept and r.quality >= 0.5 for r in rows)


def test_rates_shrink_sparse_sites(spark):
    rows = [("big", "a", 4.0)] * 400 + [("big", "b", -4.0)] * 400 + [("bad", "a", -4.0)] * 50 + [("new", "a", -4.0)]
    rates = {(r._host, r._path): r for r in quality.posteriors(spark.createDataFrame(rows, "host string, path string, evidence double")).collect()}
    assert rates["big", "a"].path_rate > 0.9 > 0.1 > rates["big", "b"].path_rate
    assert rates["bad", "a"].host_rate < rates["new", "a"].host_rate < rates["big", "a"].host_rate
    assert rates["bad", "a"].shift < 0 < rates["big", "a"].shift


def test_odd_rows(frame, spark):
    schema = "doc_id bigint, text string, source string, lang string, quality string, kept string, evidence string"
    docs = frame([(1, None), (None, "some text", None), (2, "x" * 100000, "s"), (2, "x" * 100000, "s")], schema)
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (None, 1, 0), (3, None, 1)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(docs, labels)
    assert quality.classify(docs, model).count() == 4
    assert quality.classify(docs.limit(0), model).collect() == []
    without = quality.fit(docs, labels.limit(0))
    assert all(r.kept for r in quality.classify(docs, without).collect())


def test_repeated_ids_count_once(frame, spark):
    rows = [(i, ("good words " if i % 2 else "bad thing ") * (i + 1), "s") for i in range(20)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id bigint, quality int, toxic int")
    once, often = (quality.fit(frame(docs), labels) for docs in (rows, rows + rows[3:4] * 50))
    texts = [r[1] for r in rows]
    assert np.array_equal(once.evidence(texts), often.evidence(texts))


def test_helper_names_clash(frame, spark):
    names = ["_host", "_path", "shift", "_rates", "_mark", "host", "path", "good", "rows"]
    rows = [(i, "good words" if i % 2 else "bad thing", "s", "en", *[f"{n}{i}" for n in names]) for i in range(6)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", "lang", *names])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id bigint, quality int, toxic int")
    judged = quality.classify(docs, quality.fit(docs, labels))
    assert sorted(tuple(r) for r in judged.select(docs.columns).collect()) == rows
    assert judged.columns == [*docs.columns, "evidence", "host_rate", "path_rate", "quality", "kept"]


def test_verdicts_score_each_text_once(frame, capsys):
    docs = frame([(i, f"text {i}", "a") for i in range(8)])
    rows = [("good words stand here", True), ("BAD BAD", False)] * 8
    style, bins = quality.features([text for text, _ in rows])
    model = quality.Model((quality.fit_rows(style, bins, np.array([good for _, good in rows])),))
    judged = quality.classify(docs, model, path="key").filter("kept")
    judged.select("doc_id", "text").explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1
