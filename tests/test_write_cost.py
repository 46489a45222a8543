"""What keyed writes cost: tasks of cached batches, and of days with many rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from obsweave.operators import keyed
from obsweave.session import CACHED_AQE, cached, scratch_path
from obsweave.streaming import windows

START = datetime(2025, 1, 1)
SCHEMA = "city string, timestamp timestamp, value double, n bigint"


def rows(spark, cities, n):
    return spark.createDataFrame([(f"c{i}", START + timedelta(minutes=i), float(n), n) for i in range(cities)], SCHEMA)


def test_cached_rows_have_the_partitions_their_size_asks_for(spark):
    before = spark.conf.get(CACHED_AQE, None)
    kept = cached(keyed.keep_newest(rows(spark, 50, 1), ["city", "timestamp"], "n"))
    try:
        assert kept.count() == 50 and kept.rdd.getNumPartitions() == 1 < int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert spark.conf.get(CACHED_AQE, None) == before
    finally:
        kept.unpersist()


@pytest.mark.parametrize("order", ["n", None])
def test_a_heavy_day_is_written_by_several_tasks(spark, tmp_path, monkeypatch, order):
    monkeypatch.setattr(keyed, "TASK_ROWS", 10)
    path = tmp_path / "t"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n, cities in ((1, 40), (2, 60)):
            keyed.upsert(rows(spark, cities, n), str(path), order=order)
            assert len(list(path.glob("day=*/part=*/*.parquet"))) > 1
            found = keyed.read_days(spark, str(path))
            assert found.columns == ["city", "timestamp", "value", "n", "day", "part"]
            assert sorted((r.city, r.value) for r in found.collect()) == sorted((f"c{i}", float(n)) for i in range(cities))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_places_tell_their_rows(spark):
    place = lambda frame: keyed.with_part(keyed.with_day(frame))
    batch, stored = place(rows(spark, 5, 1)), place(rows(spark, 9, 0).where(F.col("city") > "c2"))
    tomorrow = place(rows(spark, 2, 0).withColumn("timestamp", F.expr("timestamp + interval 1 day")))
    keys = ["city", "timestamp"]
    assert keyed.written_places(batch, stored.unionByName(tomorrow), keys) == [(START.date(), 0, True, 9)]
    assert keyed.written_places(batch, tomorrow, keys) == [(START.date(), 0, False, 5)]
    assert keyed.written_places(batch, None, keys) == [(START.date(), 0, False, 5)]


def test_final_windows_are_not_ranked_again(spark, tmp_path, monkeypatch):
    """A window is one row of its group: a write of windows neither orders nor caches them a second time."""

    def ranked(*_):
        raise AssertionError("unique rows ranked by key")

    monkeypatch.setattr(keyed, "keep_first", ranked)
    (tmp_path / "in").mkdir()
    for n, found in enumerate([rows(spark, 60, 1), rows(spark, 1, 1).withColumn("timestamp", F.expr("timestamp + interval 1 day"))]):
        part = found.withColumnRenamed("value", "temperature").coalesce(1)
        part.write.parquet(str(tmp_path / f"part{n}"))
        for file in (tmp_path / f"part{n}").glob("*.parquet"):
            file.rename(tmp_path / "in" / f"{n}.parquet")
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    path = scratch_path(spark, "windows")
    windows.start_windows(windows.tumbling(stream), path, scratch_path(spark, "position"), availableNow=True).awaitTermination()
    assert keyed.read_days(spark, path).agg(F.sum("rows")).first()[0] == 60


def test_unique_rows_are_inserted_once(spark, tmp_path):
    path = str(tmp_path / "t")
    assert keyed.insert_if_absent(rows(spark, 5, 1), path, unique=True) == (5, 0)
    assert keyed.insert_if_absent(rows(spark, 8, 2), path, unique=True) == (3, 5)
    assert sorted((r.city, r.n) for r in keyed.read_days(spark, path).collect()) == [(f"c{i}", 1 if i < 5 else 2) for i in range(8)]
