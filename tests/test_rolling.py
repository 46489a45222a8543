"""Rolling statistics on arrays: brute force, cuts between batches, and plans."""

import random
import statistics

import numpy as np
import pytest

from obsweave.checks import queries
from obsweave.config import FeatureConfig
from obsweave.operators import rolling
from obsweave.plans import features
from obsweave.schemas import FLAT_OBS
from test_features import START, observation, random_series


def test_array_frames_equal_brute_force():
    draw = random.Random(5)
    # Blocks on both sides of the length from which one is taken by itself.
    at = np.array(sorted({draw.randrange(1000) for _ in range(300)} | set(range(2000, 2400))))
    values = np.array([[draw.choice((None, 1e6 + draw.random(), -draw.random()))] for _ in at], float)
    found = rolling.frame_statistics(at, at // 200, 200, np.nan_to_num(values), ~np.isnan(values))
    for i, t in enumerate(at):
        frame = [v for a, (v,) in zip(at, values) if t - 200 <= a <= t and v == v]
        assert found["count"][i, 0] == len(frame)
        if frame:
            want = {"mean": statistics.fmean(frame), "min": min(frame), "max": max(frame), "sum": sum(frame)}
            want |= {"std": statistics.stdev(frame)} if len(frame) > 1 else {}
            for stat, value in want.items():
                assert found[stat][i, 0] == pytest.approx(value, rel=1e-9, abs=1e-9), (i, stat)


def test_cut_batches_change_no_digit(spark):
    config = FeatureConfig(frames="split")
    obs = spark.createDataFrame(random_series(3, rows=400, span_hours=300), FLAT_OBS)
    built = features.build_features(obs, config)
    whole = sorted(map(str, built.collect()))
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "7")
    try:
        assert sorted(map(str, features.build_features(obs, config).collect())) == whole
    finally:
        spark.conf.set(setting, before)


def test_split_frames_share_one_exchange(spark, sf_dir, capsys):
    features.windowed_features(queries.base(spark, sf_dir), FeatureConfig(frames="split"), groups=("rolling",)).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning(city") == 1 and plan.count("Sort [") == 1 and "Window [" not in plan


def test_rows_without_station_or_time_stay(spark):
    rows = [observation(i, None) for i in range(3)] + [("Madrid", None, *observation(0)[2:])]
    built = features.build_features(spark.createDataFrame(rows, FLAT_OBS), FeatureConfig(frames="split"))
    means = {(r.city, r.timestamp and r.timestamp.hour): r.temperature_mean_6h for r in built.collect()}
    hour = START.hour
    assert means == {(None, hour): 20, (None, hour + 1): 20.5, (None, hour + 2): 21, ("Madrid", None): 20}
