"""The operators with SQL, on odd rows and against it."""

import gzip

import duckdb
import pytest
from compare import compare, connect

from obsweave.llm import exact_dedup, line_dedup, oracle, queries, url_filter, warc
from obsweave.llm.common import kept
from obsweave.session import scratch_path


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), queries.QUERIES[name], oracle.SQL[name], sf_dir) is None


def answers(frame, view, sql):
    con = duckdb.connect()
    con.register("odd", frame.toPandas().convert_dtypes())
    con.execute(f"create view {view} as select * from odd")
    return con.execute(sql)


def same(spark_rows, answer):
    columns = sorted(d[0] for d in answer.description)
    order = [[d[0] for d in answer.description].index(c) for c in columns]
    want = sorted((tuple(r[i] for i in order) for r in answer.fetchall()), key=str)
    got = sorted((tuple(r[c] for c in columns) for r in spark_rows), key=str)
    assert got == want


LINE = "a line that is long enough"
ODD_DOCS = [
    (1, None), (2, ""), (3, "Text A"), (4, "TEXT a"), (5, "Ä text"), (6, "ä text"), (None, "text a"), (None, None),
    (7, LINE), (8, f"  {LINE.upper()}\t\n\n{LINE}"), (9, f"{LINE}\n{LINE}\nown line of this document"), (10, f"x\n{LINE}\r\ny"),
    (11, "\n".join(f"line number {i} of the long one" for i in range(200)) + f"\n{LINE}"), (None, LINE), (12, "word " * 20000),
]


def test_exact_dedup_odd_rows(frame):
    docs = frame([*ODD_DOCS, (3, "Text A")])
    index = exact_dedup.DigestIndex(scratch_path(docs.sparkSession, "index"), 4)
    same(exact_dedup.ingest(docs, index, "b").collect(), answers(docs, "documents", oracle.SQL["op5_exact_dedup"]))


def test_exact_dedup_next_batch(frame, spark):
    index = exact_dedup.DigestIndex(scratch_path(spark, "index"), 4)
    exact_dedup.ingest(frame([(1, "a"), (2, "b")]), index, "first").collect()
    found = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.ingest(frame([(3, "A"), (4, "c"), (5, "c")]), index, "second").collect()}
    assert found == {3: (1, False), 4: (5, False), 5: (5, True)}
    assert index.open(spark).count() == 3
    assert exact_dedup.ingest(frame([]), index, "third").collect() == []


def test_exact_dedup_batch_run_again(frame, spark, monkeypatch):
    index = exact_dedup.DigestIndex(scratch_path(spark, "index"), 4)
    exact_dedup.ingest(frame([(1, "a"), (2, "b")]), index, "first").collect()
    rows = frame([(3, "A"), (4, "c"), (5, "c"), (6, None), (None, "")])
    first = sorted(exact_dedup.ingest(rows, index, "second").collect(), key=str)
    assert sorted(exact_dedup.ingest(rows, index, "second").collect(), key=str) == first
    assert index.open(spark).count() == 4
    # Lost between the append and the verdicts.
    more = frame([(7, "d"), (8, "d"), (9, "a")])
    with monkeypatch.context() as broken:
        append = exact_dedup.DigestIndex.append
        broken.setattr(exact_dedup.DigestIndex, "append", lambda self, r: (append(self, r), 1 / 0))
        with pytest.raises(ZeroDivisionError):
            exact_dedup.ingest(more, index, "third")
    found = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.ingest(more, index, "third").collect()}
    assert found == {7: (8, False), 8: (8, True), 9: (1, False)}


def test_exact_dedup_compaction(frame, spark):
    index = exact_dedup.DigestIndex(scratch_path(spark, "index"), 4)
    for batch in range(4):
        exact_dedup.ingest(frame([(10 * batch + i, f"text {i + batch}") for i in range(9)]), index, str(batch)).collect()
    before = sorted(index.open(spark).collect())
    files = lambda: len(index.open(spark).inputFiles())
    assert files() > 4
    index = index.compact(spark)
    assert files() == 4 and sorted(index.open(spark).collect()) == before
    index = index.compact(spark, buckets=2)
    assert files() == 2 and sorted(index.open(spark).collect()) == before
    found = {r.doc_id: r.kept for r in exact_dedup.ingest(frame([(90, "text 3"), (91, "new")]), index, "last").collect()}
    assert found == {90: False, 91: True}


def test_archives_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 10)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2_000)
    rows = [(i, f"http://a.b/{i}", f"{i} " + "x" * (900 if i % 10 == 0 else 5000 if i == 7 else 50)) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    folder = scratch_path(spark, "warc")
    found = {r.page_id: r.payload_bytes for r in warc.capture_history(pages, folder).collect()}
    assert found == {i: len(html) for i, _, html in rows}
    runs = {}
    for row in warc.read_runs(spark, folder).collect():
        runs.setdefault(row.run, []).append(row.payload_bytes)
    assert max(map(len, runs.values())) == 10
    assert all(sum(sizes) <= 2_000 or len(sizes) == 1 for sizes in runs.values())


def test_helper_names_clash(spark):
    """Input columns of the helpers' own names stay as they are."""
    names = ["_id", "_keep", "_body", "_hash", "_text", "_mark", "_first", "_hit", "__mark", "position"]
    rows = [(i, f"http://example.org/en/{i}", LINE if i < 3 else "own", *[f"{n}{i}" for n in names]) for i in range(4)]
    docs = spark.createDataFrame(rows, ["doc_id", "url", "text", *names])
    for out in (
        line_dedup.dedup_lines(docs),
        url_filter.judge(docs, spark.sql(queries.URL_RULES_SQL)),
    ):
        assert sorted(tuple(r) for r in out.select(docs.columns).collect()) == rows


def test_exact_dedup_anti_join_keeps_the_buckets(frame, spark, capsys):
    index = exact_dedup.DigestIndex(scratch_path(spark, "index"), 4)
    known = index.open(spark).select("digest").hint("merge")
    new = kept(exact_dedup.digests(frame(ODD_DOCS)), "digests").repartition(4, "digest")
    new.join(known, "digest", "left_anti").explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    assert plan.count("Exchange hashpartitioning(digest#") == 1


def test_line_dedup_odd_rows(frame):
    docs = frame(ODD_DOCS)
    rows = line_dedup.dedup_lines(docs).selectExpr("doc_id", "n_lines", "n_dropped", "kept_text", "sha2(kept_text, 256) kept_sha256")
    # The SQL groups by id, so rows without one are compared by hand.
    named = frame([d for d in ODD_DOCS if d[0] is not None])
    want = answers(named, "documents", oracle.SQL["op9_line_dedup"])
    found = rows.collect()
    same([r for r in found if r.doc_id is not None], want)
    assert sorted(r.kept_text for r in found if r.doc_id is None) == ["", "", "text a"]
    assert line_dedup.dedup_lines(frame([])).collect() == []


def test_line_dedup_range_sort_without_another_exchange(frame, capsys):
    lines = line_dedup.kept(line_dedup.occurrences(frame(ODD_DOCS), "doc_id", "text", 20), "lines")
    line_dedup.repeated_lines(lines, 3).explain()
    plan = capsys.readouterr().out
    assert "rangepartitioning(h1" in plan and plan.count("Exchange hashpartitioning(h1") <= 2


def test_url_filter_odd_rows(spark):
    urls = [
        None, "", "no scheme", "http://", "http://org", "http://ORG/", "http://a.org/x?y#z", "http://example.org/es/",
        "http://sub.example.org/en/12/", "http://sub.example.org/en/2", "http://notexample.org/es/1", "http://x.com/fr/",
        "http://x.com/fr", "http://com/de/a", "http://x.com?/de/", "http://x.com/de//://y.org/", "ftp://.org/", "http://..com/de/",
        "http://x.com:80/fr/", "http://u@x.com/fr/", "http://x.com/de/é", "http://X.COM/DE/", "http://x.net/fr/",
    ]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id bigint, url string, rule string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    judged = url_filter.judge(pages, rules).collect()
    same(judged, answers(pages, "pages", oracle.SQL["op7_url_filter"]))
    assert url_filter.judge(pages.limit(0), rules).collect() == []
    assert {r.verdict for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20000).selectExpr("concat('key', id) as key")
    listed = universe.filter("substring(key, 4) % 7 = 0")
    levels = url_filter.cascade(listed, universe)
    assert len(levels) > 1
    from pyspark.sql import functions as F

    marked = universe.withColumn("held", url_filter.listed_in(levels, F.col("key")))
    assert marked.filter("held <> (substring(key, 4) % 7 = 0)").count() == 0


def test_warc_odd_rows(spark):
    body = "x" * 150
    pages = spark.createDataFrame(
        [
            (1, "http://a.b/c", None, "clash"), (2, None, "", None), (3, "http://a.b/c", body, None), (5, "u", body, None),
            (4, "http://z.a/\r\nx", body, None), (6, "u", "WARC/1.1\r\n\r\n\r\n" + body, None), (None, "u", body, None),
            (7, "u", "short", None), (8, "u", "short", None), (9, "é", "é" * 60, None),
        ],
        "page_id bigint, url string, html string, captured string",
    )
    rows = {r.page_id: r for r in warc.capture_history(pages).collect()}
    assert len(rows) == 10
    assert {i: (r.record_type, r.refers_to) for i, r in rows.items() if r.record_type == "revisit"} == {
        4: ("revisit", 3), 5: ("revisit", 3), None: ("revisit", 3)
    }
    assert rows[9].payload_bytes == 120 and rows[1].payload_bytes == 0 and rows[5].payload_bytes == 150
    order = [warc._order((r.url_key, r.captured, r.page_id)) for r in warc.capture_history(pages).collect()]
    assert order == sorted(order)
    assert warc.capture_history(pages.limit(0)).collect() == []


@pytest.mark.parametrize("k", range(8))
def test_loser_tree(k):
    runs = [sorted((str(i * j % 11), "t", i * 100 + j) for j in range(i * 3 % 7)) for i in range(k)]
    runs = [sorted(r, key=warc._order) for r in runs]
    assert list(warc.loser_tree(runs)) == sorted((r for run in runs for r in run), key=warc._order)


def test_archive_of_one_member_a_record():
    for n, size in ((3, 10), (40, 9000)):
        bodies = [bytes([65 + i % 26]) * size + str(i).encode() for i in range(n)]
        raw = [b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (len(b), b) for b in bodies]
        for content in (b"".join(map(gzip.compress, raw)), gzip.compress(b"".join(raw))):
            found = list(warc.parse_archive(content))
            assert [block for _, _, block in found] == bodies
            assert [at for at, _, _ in found] == [sum(map(len, raw[:i])) for i in range(n)]
