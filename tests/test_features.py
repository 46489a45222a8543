"""Feature derivation against brute force, hand-made rows and invariants."""

import math
import random
import statistics
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from obsweave.config import FeatureConfig
from obsweave.plans import features, incremental
from obsweave.schemas import FLAT_OBS, MEASURES

START = datetime(2025, 6, 15, 10, tzinfo=timezone.utc)


def observation(i=0, city="Madrid", at=None, **values):
    row = dict.fromkeys(MEASURES, 0.0)
    row |= {
        "temperature": 20.0 + i,
        "feels_like": 19.0 + i,
        "humidity": 55.0,
        "pressure": 1013.0,
        "wind_speed": 5.2,
        "wind_direction": 270.0,
    }
    row |= values
    when = at or START + timedelta(hours=i)
    return (city, when, *[row[m] for m in MEASURES])


@pytest.fixture(scope="module")
def madrid(spark):
    return spark.createDataFrame([observation(i) for i in range(5)], FLAT_OBS)


def ordered(df):
    return df.orderBy("city", "timestamp").collect()


def test_contract_has_148_columns(madrid):
    built = features.build_features(madrid)
    assert len(built.columns) == len(set(built.columns)) == 148
    assert built.columns[:2] == ["city", "timestamp"]
    assert built.columns[-2:] == ["target_temp_1h", "target_will_rain_1h"]


def test_reference_rows(madrid):
    rows = ordered(features.build_features(madrid))
    assert all(r.specific_humidity > 0 for r in rows)
    assert all(r.wind_u > 0 and abs(r.wind_v) < 0.5 for r in rows)
    assert all(-1 <= r[c] <= 1 for r in rows for c in ("hour_sin", "hour_cos", "month_sin", "month_cos"))
    assert [r.hour for r in rows] == [10, 11, 12, 13, 14]
    assert rows[0].day_of_week == 1  # a Sunday
    assert [r.target_temp_1h for r in rows] == [21, 22, 23, 24, None]
    assert [r.target_will_rain_1h for r in rows] == [0] * 5
    assert [r.temp_change_1h for r in rows] == [None, 1, 1, 1, 1]
    assert [r.temperature_lag_3h for r in rows] == [None, None, None, 20, 21]
    assert all(r.precip_sum_6h == 0 for r in rows)
    assert rows[0].temperature_std_6h is None and rows[1].temperature_std_6h == pytest.approx(
        math.sqrt(0.5)
    )


def test_undefined_humidity_is_null(spark):
    rows = [observation(0, temperature=-243.5), observation(1, temperature=None), observation(2)]
    found = ordered(features.with_physics(spark.createDataFrame(rows, FLAT_OBS)))
    assert [r.specific_humidity is None for r in found] == [True, True, False]


def test_absent_measure_is_skipped(madrid):
    built = features.build_features(madrid.drop("cape", "shortwave_radiation", "rain"))
    assert not [c for c in built.columns if c.startswith(("cape", "shortwave", "target_will"))]
    assert built.count() == 5


@pytest.mark.parametrize("frames", ["sliding", "split"])
def test_range_frames_close_both_ends(spark, frames):
    obs = spark.createDataFrame([observation(i, cape=1.0) for i in range(12)], FLAT_OBS)
    built = features.build_features(obs.withColumn("precipitation", F.lit(1.0)), FeatureConfig(frames=frames))
    counts = [r.precip_sum_6h for r in ordered(built)]
    assert counts == [1, 2, 3, 4, 5, 6, 7, 7, 7, 7, 7, 7]


@pytest.mark.parametrize("frames", ["sliding", "split"])
def test_gap_moves_lags_by_rows_and_frames_by_time(spark, frames):
    times = [0, 1, 5, 6, 30]
    rows = [observation(i, at=START + timedelta(hours=h)) for i, h in enumerate(times)]
    found = ordered(features.build_features(spark.createDataFrame(rows, FLAT_OBS), FeatureConfig(frames=frames)))
    assert [r.temperature_lag_1h for r in found] == [None, 20, 21, 22, 23]
    assert [r.temperature_mean_6h for r in found] == [20, 20.5, 21, 21.5, 24]
    assert [r.temperature_min_24h for r in found] == [20, 20, 20, 20, 23]


def test_two_cities_do_not_mix(spark):
    rows = [observation(i, c) for i in range(4) for c in ("Palma", "Madrid")]
    rows.append(observation(9, "Single"))
    found = ordered(features.build_features(spark.createDataFrame(rows, FLAT_OBS)))
    lone = found[-1]
    assert lone.city == "Single" and lone.target_temp_1h is None and lone.target_will_rain_1h == 0
    assert lone.temperature_std_6h is None
    assert [r.temperature_lag_1h for r in found[:4]] == [None, 20, 21, 22]


def random_series(seed, cities=4, rows=160, span_hours=2400):
    """Irregular series with gaps, nulls, dense bursts and rows before 1970."""
    rng = random.Random(seed)
    out = []
    for city in range(cities):
        first = datetime(1969, 12, 20, tzinfo=timezone.utc) if city == 0 else START
        seconds = set()
        while len(seconds) < rows:
            at = rng.randrange(span_hours * 3600)
            burst = rng.choice([1, 1, 1, 30])
            seconds |= {at + 60 * k for k in range(burst)}
        for s in sorted(seconds)[:rows]:
            values = {m: round(rng.uniform(-20, 1000), 3) for m in MEASURES}
            values["humidity"] = None if rng.random() < 0.1 else values["humidity"]
            out.append(observation(city=f"c{city}", at=first + timedelta(seconds=s), **values))
    return out


def brute_force(rows, config):
    """Lags, frames, differences and targets of every row by direct search."""
    answers = {}
    by_city = {}
    for row in rows:
        by_city.setdefault(row[0], []).append((row[1], dict(zip(MEASURES, row[2:]))))
    for city, points in by_city.items():
        points.sort(key=lambda p: p[0])
        for i, (at, values) in enumerate(points):
            answer = {}
            for k in config.lag_rows:
                answer[f"humidity_lag_{k}h"] = points[i - k][1]["humidity"] if i >= k else None
            for h in config.rolling_hours:
                frame = [
                    v["humidity"]
                    for t, v in points
                    if at - timedelta(hours=h) <= t <= at and v["humidity"] is not None
                ]
                answer[f"humidity_mean_{h}h"] = sum(frame) / len(frame) if frame else None
                answer[f"humidity_std_{h}h"] = statistics.stdev(frame) if len(frame) > 1 else None
                answer[f"humidity_min_{h}h"] = min(frame, default=None)
                answer[f"humidity_max_{h}h"] = max(frame, default=None)
            rain = [v["precipitation"] for t, v in points if at - timedelta(hours=6) <= t <= at]
            answer["precip_sum_6h"] = sum(rain)
            later = points[i + config.horizon][1] if i + config.horizon < len(points) else None
            answer[f"target_temp_{config.horizon}h"] = later and later["temperature"]
            answer[f"target_will_rain_{config.horizon}h"] = int(bool(later and later["rain"] > 0))
            answers[city, at] = answer
    return answers


def same(a, b):
    if a is None or b is None:
        return a is b
    return a == pytest.approx(b, rel=1e-9, abs=1e-7)


@pytest.mark.parametrize("frames", ["sliding", "split"])
@pytest.mark.parametrize("bucket_hours, horizon", [(24, 1), (168, 3)])
def test_features_equal_brute_force(spark, frames, bucket_hours, horizon):
    config = FeatureConfig(bucket_hours=bucket_hours, horizon=horizon, frames=frames)
    rows = random_series(bucket_hours)
    built = features.build_features(spark.createDataFrame(rows, FLAT_OBS), config)
    want = brute_force(rows, config)
    found = built.collect()
    assert len(found) == len(want)
    for row in found:
        answer = want[row.city, row.timestamp.replace(tzinfo=timezone.utc)]
        wrong = {k: (row[k], v) for k, v in answer.items() if not same(row[k], v)}
        assert not wrong, (row.city, row.timestamp, wrong)


def test_building_starts_no_job(spark, madrid):
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    for frames in ("sliding", "split"):
        features.build_features(madrid, FeatureConfig(frames=frames, resample="hour"))
    assert set(tracker.getJobIdsForGroup(None)) == before


def test_hourly_rows(spark):
    rows = [observation(i, at=START + timedelta(minutes=20 * i)) for i in range(7)]
    found = ordered(features.build_features(spark.createDataFrame(rows, FLAT_OBS), FeatureConfig(resample="hour")))
    assert [r.temperature for r in found] == [22, 25, 26]
    assert [r.temperature_lag_1h for r in found] == [None, 22, 25]


def test_constant_dense_series_has_zero_spread(spark):
    rows = [observation(at=START + timedelta(minutes=17 * i), pressure=1013.1) for i in range(200)]
    built = features.build_features(spark.createDataFrame(rows, FLAT_OBS), FeatureConfig(frames="split"))
    spreads = [r[0] for r in built.select("pressure_std_24h").collect()]
    assert spreads.count(None) == 1 and max(s for s in spreads if s is not None) < 1e-9


def test_bucket_must_cover_the_frames():
    with pytest.raises(ValueError):
        FeatureConfig(bucket_hours=12)


@pytest.mark.parametrize("bucket_hours, frames", [(24, "sliding"), (168, "sliding"), (168, "split")])
def test_refresh_equals_full_derivation(spark, bucket_hours, frames):
    config = FeatureConfig(bucket_hours=bucket_hours, horizon=2, frames=frames)
    rows = random_series(7)
    rng = random.Random(1)
    late = {i for i in range(len(rows)) if rng.random() < 0.03}
    obs = spark.createDataFrame(rows, FLAT_OBS)
    old = spark.createDataFrame([r for i, r in enumerate(rows) if i not in late], FLAT_OBS)
    changed = spark.createDataFrame(
        [r[:2] for i, r in enumerate(rows) if i in late], "city string, timestamp timestamp"
    )
    stale = features.build_features(old, config)
    refresh = incremental.Refresh(obs, changed, config)
    full = features.build_features(obs, config)
    assert ordered(refresh.replaced(stale)) == ordered(full)
    assert refresh.fresh().count() < full.count()


def test_dropping_incomplete_rows(spark):
    rows = [observation(i) for i in range(4)] + [observation(4, humidity=float("nan"))]
    built = features.build_features(spark.createDataFrame(rows, FLAT_OBS))
    assert features.complete_rows(built).count() == 4
    assert features.summary(features.complete_rows(built)).first().avg_temp == 21.5
