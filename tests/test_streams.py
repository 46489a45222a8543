"""Streams with state: windows, first-wins dedup and live features, with late rows and restarts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from obsweave.operators import keyed
from obsweave.plans import features
from obsweave.session import scratch_path
from obsweave.streaming import dedup, live_features, windows

START = datetime(2025, 1, 1)
OBS = "city string, timestamp timestamp, temperature double"


class Feed:
    """A folder that a stream reads file by file, in the order they were put there."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, folder, schema, 0
        folder.mkdir()

    def put(self, rows):
        self.n += 1
        part = self.folder / f"{self.n:03d}"
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(str(part))
        for file in part.glob("*.parquet"):
            file.rename(self.folder / f"{self.n:03d}.parquet")

    def stream(self):
        schema = self.spark.createDataFrame([], self.schema).schema
        return self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(str(self.folder))


@pytest.fixture
def feed(spark, tmp_path):
    return lambda schema, name="in": Feed(spark, tmp_path / name, schema)


def at(hours):
    return START + timedelta(hours=hours)


def run(make, feed, path, position):
    query = windows.start_windows(make(feed.stream()), path, position, availableNow=True)
    query.awaitTermination()
    return windows.late_rows(query)


@pytest.mark.parametrize("make", [windows.tumbling, windows.sliding, windows.sessions])
def test_windows_over_batches_with_late_rows(spark, feed, make):
    draw, source = random.Random(7), feed(OBS)
    path, position = scratch_path(spark, "windows"), scratch_path(spark, "position")
    rows = [(draw.choice("ab"), at(h / 4), float(draw.randrange(40))) for h in range(400)]
    # Shuffled by less than the delay: nothing is late.
    shuffled = sorted(rows, key=lambda r: r[1] + timedelta(minutes=draw.randrange(100)))
    for i in range(0, 400, 100):
        source.put(shuffled[i : i + 100])
    assert run(make, source, path, position) == 0
    # Too late: counted, and no window changes.
    source.put([("a", at(1), 1000.0), ("b", at(2), 1000.0), ("a", at(99), 5.0), ("a", at(300), 5.0), ("b", at(300), 5.0)])
    source.put([("a", at(400), 5.0)])
    late = run(make, source, path, position)  # from where the first run stopped
    assert late >= 2
    accepted = spark.createDataFrame([*rows, ("a", at(99), 5.0), ("a", at(300), 5.0), ("b", at(300), 5.0)], OBS)
    want = make(accepted).where(F.col("end") <= F.lit(at(398)).cast("timestamp"))
    got = keyed.read_days(spark, path)
    got = got.select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and not got.isEmpty()


def test_replayed_windows_add_nothing(spark):
    rows = spark.createDataFrame([("a", at(h), 1.0 * h) for h in range(9)], OBS)
    path = scratch_path(spark, "windows")
    for _ in range(2):
        keyed.insert_if_absent(windows.tumbling(rows), path, keys=("city", "start"), time="start")
    assert keyed.read_days(spark, path).count() == 9


def test_first_wins(spark, feed):
    schema = "id string, received_at timestamp, value bigint"
    source = feed(schema)
    path, position = scratch_path(spark, "first"), scratch_path(spark, "position")
    start = lambda: dedup.start_first_wins(source.stream(), path, position, ["id"], within="2 days", availableNow=True).awaitTermination()
    source.put([("x", at(0), 1), ("y", at(1), 1), (None, at(1), 1)])
    source.put([("x", at(5), 2), ("z", at(6), 2), (None, at(7), 2)])
    start()
    source.put([("y", at(9), 3), ("x", at(0), 9), ("w", at(10), 3)])
    start()
    values = {r.id: r.value for r in keyed.read_days(spark, path).collect()}
    assert values == {"x": 1, "y": 1, "z": 2, "w": 3, None: 1}
    # A batch that was written before its commit failed is written again: the insert adds none of it.
    before = keyed.read_days(spark, path).count()
    again = spark.createDataFrame([("y", at(1), 1), ("w", at(10), 3)], schema)
    assert keyed.insert_if_absent(again, path, keys=["id", "received_at"], time="received_at", part_by="id") == (0, 2)
    assert keyed.read_days(spark, path).count() == before


MEASURED = "city string, timestamp timestamp, temperature double, humidity double, pressure double, wind_speed double, wind_direction double, precipitation double, shortwave_radiation double, cape double, rain double"


def test_live_features_equal_the_batch(spark, feed):
    """Shuffled and late input, gaps and nulls, and a restart between."""
    live_features.use_state_store(spark)
    draw, source = random.Random(11), feed(MEASURED)
    value = lambda: None if draw.random() < 0.05 else float(draw.randrange(1, 90))
    hours = [h for h in range(120) if not 40 < h < 70]
    rows = [(c, at(h) + timedelta(minutes=draw.randrange(55)), *[value() for _ in range(9)]) for c in ("a", "b") for h in hours]
    rows += [("rare", at(3), *[value() for _ in range(9)])]
    shuffled = sorted(rows, key=lambda r: r[1] + timedelta(minutes=draw.randrange(170)))
    parts = [shuffled[i : i + 30] for i in range(0, len(shuffled), 30)]
    path, position = scratch_path(spark, "live"), scratch_path(spark, "position")

    def run():
        found = live_features.live_features(features.with_physics(source.stream()), delay="3 hours")
        query = found.writeStream.format("parquet").outputMode("append").option("checkpointLocation", position)
        query.option("path", path).trigger(availableNow=True).start().awaitTermination()

    for part in parts[:4]:
        source.put(part)
    run()
    for part in parts[4:]:
        source.put(part)
    last = max(r[1] for r in rows)
    source.put([("a", at(0), *[1.0] * 9), (None, at(119), *[1.0] * 9)])  # too late; no station
    source.put([("end", last + timedelta(hours=9), *[1.0] * 9)])
    run()
    batch = features.windowed_features(features.with_physics(spark.createDataFrame(rows, MEASURED)), groups=("lag", "rolling", "delta"))
    got = {(r.city, r.timestamp): r for r in spark.read.parquet(path).collect()}
    want = {(r.city, r.timestamp): r for r in batch.collect()}
    assert set(got) == set(want)
    names = live_features.Derivation(live_features.FeatureConfig()).names
    assert len(names) == 111
    for key, row in want.items():
        for name in names:
            assert got[key][name] == pytest.approx(row[name], rel=1e-9, abs=1e-9) if row[name] is not None else got[key][name] is None, (key, name)


def test_ring_is_bounded():
    derivation = live_features.Derivation(live_features.FeatureConfig())
    assert derivation.ring_rows == 12 and derivation.ring_micros == 24 * 3_600_000_000


def test_passed_spans_come_out_by_one_timer(spark, feed, monkeypatch):
    """Days that the watermark has passed together are derived at once, not by a timer each."""
    live_features.use_state_store(spark)
    source, path, position = feed(MEASURED), scratch_path(spark, "live"), scratch_path(spark, "position")
    source.put([(c, at(6 * h), *[float(h + 1)] * 9) for c in "ab" for h in range(40)])
    source.put([("a", at(400), *[1.0] * 9)])
    found = live_features.live_features(features.with_physics(source.stream()), every_hours=24)
    query = found.writeStream.format("parquet").outputMode("append").option("checkpointLocation", position)
    query = query.option("path", path).trigger(availableNow=True).start()
    query.awaitTermination()
    # Ten days of each station wait for the watermark: timers are set for what waits first, not for all of them.
    custom = [state["customMetrics"] for step in query.recentProgress for state in step["stateOperators"]]
    assert sum(int(metrics.get("numRegisteredTimers", 0)) for metrics in custom) < 10
    assert spark.read.parquet(path).count() == 80
