"""What the refresh queries write to disk beside their tables."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from obsweave.checks.queries import excess_rows
from obsweave.config import FeatureConfig
from obsweave.operators import keyed
from obsweave.plans import features, incremental
from obsweave.schemas import FLAT_OBS
from obsweave.session import scratch_path
from test_features import random_series

DENSE = FeatureConfig(frames="split")


FIELDS = "spark.sql.debug.maxToStringFields"


def plan_of(frame, capsys):
    conf = frame.sparkSession.conf
    conf.set(FIELDS, "1000")
    capsys.readouterr()
    frame.explain()
    conf.unset(FIELDS)
    return capsys.readouterr().out


def values(frame):
    return sorted(map(str, frame.select(sorted(frame.columns)).collect()))


def series_rows(spark, late=None):
    obs = spark.createDataFrame(random_series(7), FLAT_OBS)
    mark = F.pmod(F.xxhash64("city", "timestamp"), F.lit(30)) == 0
    return obs if late is None else obs.where(mark if late else ~mark)


# --- comparing --------------------------------------------------------------

SCHEMA = "city string, timestamp timestamp, a double, b double, n int"
BASE = [("x", None, 1.0, None, 3), ("x", None, 1.0, None, 3), (None, None, None, 2.0, None), ("y", None, float("nan"), 0.0, 1)]


@pytest.mark.parametrize(
    "changed, differing",
    [
        (BASE, 0),
        ([*BASE[:3], ("y", None, float("nan"), -0.0, 1)], 0),
        ([("x", None, None, 1.0, 3), *BASE[1:]], 2),
        ([(None, None, 2.0, None, None) if row[0] is None else row for row in BASE], 2),
        (BASE[1:], 1),
        ([*BASE, BASE[2]], 1),
        ([*BASE[:3], ("y", None, float("nan"), 5e-324, 1)], 2),
    ],
)
def test_rows_that_differ_are_counted(spark, changed, differing):
    found = excess_rows(spark.createDataFrame(BASE, SCHEMA), spark.createDataFrame(changed, SCHEMA)).first()
    assert found.asDict() == {"rows": 4, "differing": differing}


def test_rows_are_compared_without_shuffling_them(spark, capsys):
    built = features.build_features(series_rows(spark), DENSE)
    keys = re.findall(r"HashAggregate\(keys=\[(city.*?)\], functions=\[(?:partial_)?sum\(_side", plan_of(excess_rows(built, built), capsys))
    assert keys and all(found.count("#") == 4 for found in keys), keys


# --- deriving ---------------------------------------------------------------


def test_split_frames_add_no_exchange(spark, capsys):
    count = {}
    for frames in ("sliding", "split"):
        plan = plan_of(features.build_features(series_rows(spark), FeatureConfig(frames=frames)), capsys)
        count[frames] = plan.count("Exchange hashpartitioning(city"), plan.count("Sort [")
    assert count["split"] == count["sliding"]


def test_calendar_columns_are_not_shuffled(spark, capsys):
    plan = plan_of(features.build_features(series_rows(spark), DENSE), capsys)
    assert plan.index("hour_sin") < plan.index("Exchange") < plan.index("Scan") and "hour_sin" not in plan[plan.index("Exchange") :]


@pytest.mark.parametrize("frames", ["sliding", "split"])
def test_buckets_and_slots_change_no_digit(spark, frames):
    obs = spark.createDataFrame([*random_series(2, rows=300, span_hours=700), *[("Madrid", None, *row[2:]) for row in random_series(1)[:1]]], FLAT_OBS)
    want = values(features.build_features(obs, FeatureConfig(frames=frames)))
    for hours, slots in ((24, None), (100, None), (100, 3), (168, 2)):
        found = features.build_features(obs, FeatureConfig(frames=frames, bucket_hours=hours), slots)
        assert values(found.drop(keyed.SLOT)) == want, (hours, slots)


@pytest.mark.parametrize("rows", [10, 1_000_000])
@pytest.mark.parametrize("config", [FeatureConfig(), DENSE])
def test_derived_and_refreshed_rows_are_written_where_they_are(spark, monkeypatch, capsys, rows, config):
    """A write of feature rows deals out none of them again, and replaced rows are not shuffled to find them."""
    monkeypatch.setattr(incremental, "DERIVED_ROWS", rows, raising=False)
    monkeypatch.setattr(incremental, "STRETCH", 20, raising=False)
    plans, write = [], keyed.write_days

    def kept_plan(frame, path, *args, **kinds):
        if "temperature_mean_6h" in frame.columns:
            plans.append((frame.columns, plan_of(frame, capsys)))
        return write(frame, path, *args, **kinds)

    for module in (keyed, incremental):
        monkeypatch.setattr(module, "write_days", kept_plan)
    path, obs_path = scratch_path(spark, "features"), scratch_path(spark, "obs")
    write(keyed.with_day(series_rows(spark, False)), obs_path, "overwrite")
    incremental.derive_features(keyed.read_days(spark, obs_path), path, config)
    write(keyed.with_day(series_rows(spark, True)), obs_path, "append")
    spark.catalog.refreshByPath(obs_path)
    changed = series_rows(spark, True).select("city", "timestamp")
    incremental.refresh_features(keyed.read_days(spark, obs_path), changed, path)
    assert values(spark.read.parquet(path).drop("day")) == values(features.build_features(series_rows(spark), config))
    assert incremental.saved_config(spark, path) == config
    assert len(plans) == 2 and all(keyed.SLOT in columns for columns, _ in plans)
    assert "LeftAnti" not in plans[1][1] and "LeftOuter, BuildRight" in plans[1][1]


def test_a_write_deletes_what_it_shuffled(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def shuffled():
        return {str(f) for folder in folders for f in Path(folder).rglob("shuffle_*.data")}

    before = shuffled()
    rows = spark.range(1000).select(F.timestamp_seconds("id").alias("timestamp"), F.lit("a").alias("city"))
    keyed.write_days(keyed.with_day(rows), scratch_path(spark, "written"), "overwrite")
    assert shuffled() <= before
