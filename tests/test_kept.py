"""Tables that follow others: newest rows, bucket counts, and what a failed write leaves."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from obsweave import session
from obsweave.config import FeatureConfig
from obsweave.operators import keyed
from obsweave.plans import features, incremental, scoring, serving
from obsweave.schemas import PREDICTIONS
from obsweave.session import scratch_path

START = datetime(2025, 1, 1)
SCHEMA = "city string, timestamp timestamp, value double, n bigint"


def hours(n):
    return START + timedelta(hours=n)


def values(frame):
    return sorted((r.city or "", r.timestamp, r.value) for r in frame.collect())


def newest_by_hand(history, keep=1):
    """The newest rows of each city of a history {(city, time): (order, value)}."""
    found = {}
    for (city, time), (_, value) in history.items():
        found.setdefault(city, []).append((time, value))
    return sorted((city or "", time, value) for city, rows in found.items() for time, value in sorted(rows, reverse=True)[:keep])


@pytest.mark.parametrize("keep", [1, 3])
def test_newest_rows_follow_late_and_corrected_writes(spark, keep):
    draw, path, history = random.Random(keep), scratch_path(spark, "history"), {}
    table = keyed.NewestTable(path + "_newest", order="n", keep=keep, parts=3)
    order = 0
    for batch in range(6):
        rows = []
        for _ in range(25):
            order += 1
            # Some writes are older than what was written before them.
            n = order - draw.choice([0, 0, 0, 60])
            rows.append((draw.choice(["a", "b", "c", None]), hours(draw.randrange(40)), float(order), n))
        frame = spark.createDataFrame(rows, SCHEMA)
        keyed.upsert(frame, path, order="n", newest=[table])
        if batch == 2:  # written again after a failure
            keyed.upsert(frame, path, order="n", newest=[table])
        best = {}
        for city, time, value, n in rows:
            if (city, time) not in best or n > best[city, time][0]:
                best[city, time] = (n, value)
        for key, (n, value) in best.items():
            if key not in history or n >= history[key][0]:
                history[key] = (n, value)
        assert values(table.read(spark)) == newest_by_hand(history, keep)
    for city in ("a", None, "absent"):
        want = [row for row in newest_by_hand(history, keep) if row[0] == (city or "")]
        assert values(table.of(spark, city)) == want
    table.rebuild(keyed.read_days(spark, path))
    assert values(table.read(spark)) == newest_by_hand(history, keep)


def test_newest_rows_follow_inserts(spark):
    path = scratch_path(spark, "history")
    table = keyed.NewestTable(path + "_newest")
    rows = lambda *found: spark.createDataFrame([(c, hours(h), float(v), 0) for c, h, v in found], SCHEMA)
    keyed.insert_if_absent(rows(("a", 5, 1), ("b", 9, 1)), path, newest=[table])
    keyed.insert_if_absent(rows(("a", 5, 2), ("a", 7, 2), ("b", 3, 2), ("c", 1, 2)), path, newest=[table])
    assert values(table.read(spark)) == [("a", hours(7), 2.0), ("b", hours(9), 1.0), ("c", hours(1), 2.0)]
    assert table.read(spark).columns == ["city", "timestamp", "value", "n"]


def test_reads_touch_the_newest_table_only(spark, capsys):
    path = scratch_path(spark, "predictions")
    row = lambda city, h, made, t: (city, hours(h), hours(made), t, 0.0, t, 1, "m", "1", "m", "1")
    scoring.save_predictions(spark.createDataFrame([row("a", h, h, 1.0 * h) for h in range(40)] + [row("b", 1, 1, 5.0)], PREDICTIONS), path)
    scoring.save_predictions(spark.createDataFrame([row("a", 3, 50, 99.0), row("b", 0, 0, 4.0)], PREDICTIONS), path)
    newest = scoring.newest_predictions(path)
    latest = {r.city: r.predicted_temperature for r in serving.latest_predictions_now(newest, spark).collect()}
    assert latest == {"a": 99.0, "b": 5.0}
    found = serving.city_predictions_now(newest, spark, "a", 3)
    assert [r.predicted_temperature for r in found.collect()] == [99.0, 39.0, 38.0]
    history = spark.read.parquet(path)
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in serving.city_predictions(history, "a", 3).collect()]
    with pytest.raises(ValueError):
        serving.city_predictions_now(newest, spark, "a", 25)
    assert serving.city_predictions_now(newest, spark, "nowhere").isEmpty()
    assert serving.latest_predictions_now(scoring.newest_predictions(path + "x"), spark).isEmpty()
    assert all(f"{path}_newest/" in file for file in newest.of(spark, "a").inputFiles())
    found.explain()
    assert re.search(r"PartitionFilters: \[[^\]]*\(part#\d+ = \d", capsys.readouterr().out)


def test_parts_are_a_setting_of_the_table(spark, tmp_path):
    rows = spark.createDataFrame([(f"c{i}", hours(0), 1.0, i) for i in range(50)], SCHEMA)
    path = str(tmp_path / "t")
    keyed.upsert(rows, path, parts=4)
    keyed.upsert(rows, path)
    assert len(list((tmp_path / "t").glob("day=*/part=*"))) == 4 and keyed.read_days(spark, path).count() == 50
    with pytest.raises(ValueError):
        keyed.upsert(rows, path, parts=2)


def series(spark, late):
    """Two cities with gaps; ``late`` picks rows of one hour in eleven."""
    draw = random.Random(3)
    rows = [(c, hours(h) + timedelta(minutes=draw.randrange(60)), draw.random() * 30, 50.0, 1000.0, 4.0) for c in "ab" for h in range(0, 700, 2) if not 200 < h < 400]
    obs = spark.createDataFrame(rows, "city string, timestamp timestamp, temperature double, humidity double, pressure double, wind_speed double")
    mark = F.pmod(F.xxhash64("city", "timestamp"), F.lit(11)) == 0
    return obs.where(mark if late else ~mark)


def test_failed_derivation_leaves_the_table(spark):
    path = scratch_path(spark, "features")
    obs = series(spark, False)
    incremental.derive_features(obs, path)
    before = sorted(map(str, spark.read.parquet(path).collect()))
    broken = obs.withColumn("temperature", F.when(F.col("temperature") < 29, F.col("temperature")).otherwise(F.raise_error(F.lit("lost")).cast("double")))
    with pytest.raises(Exception, match="lost"):
        incremental.derive_features(broken, path, FeatureConfig(lag_rows=(1,)))
    spark.catalog.refreshByPath(path)
    assert sorted(map(str, spark.read.parquet(path).collect())) == before
    assert incremental.saved_config(spark, path) == FeatureConfig()


@pytest.mark.parametrize("resample", [None, "hour"])
def test_indexed_refresh_equals_full(spark, resample):
    config = FeatureConfig(resample=resample) if resample else FeatureConfig()
    early, late = series(spark, False), series(spark, True)
    twins = late.withColumn("timestamp", F.date_trunc("hour", "timestamp") + F.expr("interval 59 minutes 59 seconds"))
    late = late.unionByName(twins)  # take the place of a row of their hour, where one counts
    path, obs_path = scratch_path(spark, "features"), scratch_path(spark, "obs")
    keyed.write_days(keyed.with_day(early), obs_path, "overwrite")
    incremental.derive_features(keyed.read_days(spark, obs_path), path, config)
    keyed.write_days(keyed.with_day(late), obs_path, "append")
    spark.catalog.refreshByPath(obs_path)
    everything = keyed.read_days(spark, obs_path)
    incremental.refresh_features(everything, late.select("city", "timestamp"), path)
    got = spark.read.parquet(path)
    full = features.build_features(everything.drop("day"), config)
    assert got.count() == full.count()
    assert full.exceptAll(got.select(full.columns)).isEmpty()
    # Running it again changes nothing, the index included.
    index = incremental.stored_index(path, config)
    counts = sorted(index.read(spark).where("rows > 0").collect())
    incremental.refresh_features(everything, late.select("city", "timestamp"), path)
    assert sorted(index.read(spark).where("rows > 0").collect()) == counts
    index.build(everything)
    assert sorted(index.read(spark).collect()) == counts


def test_refresh_reads_reached_days_only(spark, capsys):
    path, obs_path = scratch_path(spark, "features"), scratch_path(spark, "obs")
    keyed.write_days(keyed.with_day(series(spark, False)), obs_path, "overwrite")
    obs = keyed.read_days(spark, obs_path)
    incremental.derive_features(obs, path)
    changed = spark.createDataFrame([("a", hours(10))], "city string, timestamp timestamp")
    refresh = incremental.Refresh(obs, changed, FeatureConfig(), incremental.stored_index(path, FeatureConfig()))
    capsys.readouterr()
    refresh.fresh().explain()
    scans = [line for line in capsys.readouterr().out.splitlines() if "FileScan" in line and "temperature" in line]
    assert scans and all(re.search(r"PartitionFilters: \[[^\]]*day#\d+ (IN|=)", line) for line in scans)


def test_scratch_can_be_removed(spark, monkeypatch):
    monkeypatch.setattr(session, "_scratch", {})
    rows = session.stored(spark.range(3), "kept")
    assert rows.count() == 3 and session.remove_scratch(spark) == 1 and session.remove_scratch(spark) == 0
    with pytest.raises(Exception):
        spark.read.parquet(rows.inputFiles()[0]).count()


def test_a_cluster_needs_a_shared_folder(spark):
    class Elsewhere:
        conf = type("Conf", (), {"get": staticmethod(lambda name, *default: default[0] if default else "file:/home/me/warehouse")})
        sparkContext = type("Context", (), {"master": "spark://somewhere:7077", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError, match="checkpoint.dir"):
        session.shared_dir(Elsewhere)
