"""Splits, metrics, training, registry and scoring on small grids."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from obsweave.config import TrainingConfig
from obsweave.operators import metrics, split
from obsweave.plans import features, jobs, scoring, serving, training
from obsweave.schemas import PREDICTIONS
from obsweave.operators.keyed import read_days, upsert, with_day
from obsweave.sources.tables import read_features, read_raw

TINY = TrainingConfig(
    folds=2,
    regression_grids={
        "GradientBoostedTrees": {"maxDepth": [2], "maxIter": [2], "stepSize": [0.1]},
        "RandomForest": {"numTrees": [3], "maxDepth": [2], "minInstancesPerNode": [1]},
        "LinearRegression": {"elasticNetParam": [0.0], "regParam": [0.1]},
    },
    classification_grids={
        "GradientBoostedTrees": {"maxDepth": [2], "maxIter": [2], "stepSize": [0.1]},
        "RandomForest": {"numTrees": [3], "maxDepth": [2], "minInstancesPerNode": [1]},
    },
)


def raw_table(spark, path, hours=150):
    """Raw observations of two cities with a daily cycle and some rain."""
    rows = spark.range(hours).select(
        "id", F.explode(F.create_map(*map(F.lit, ("Madrid", 1.0, "Palma", 3.0)))).alias("city", "shift")
    )
    t = F.col("id").cast("double")
    reading = {
        "temperature_2m": 15 + 8 * F.sin(t * 2 * math.pi / 24) + F.col("shift"),
        "relative_humidity_2m": 50 + 20 * F.cos(t * 2 * math.pi / 24),
        "rain": F.when(F.col("id") % 5 == 0, 0.4).otherwise(0.0),
    }
    from obsweave.schemas import PAYLOAD, READINGS

    current = F.struct(
        F.lit(None).cast("bigint").alias("time"),
        *[reading.get(n, F.lit(1000.0) + t / 100 + F.col("shift")).alias(n) for n in READINGS],
    )
    payload = F.struct("city", F.lit(1.0), F.lit(2.0), F.lit(0), F.lit("UTC"), current).cast(PAYLOAD)
    start = F.lit(datetime(2025, 6, 1))
    table = rows.select(
        "city",
        (start + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("timestamp"),
        F.lit("ok").alias("time_status"),
        payload.alias("payload"),
    )
    upsert(table, path)
    return table


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("jobs"))
    raw_table(spark, f"{base}/raw")
    counts = jobs.run_features(spark, f"{base}/raw", f"{base}/features")
    assert counts == {"derived": 300, "usable": 300}
    return base


@pytest.fixture(scope="module")
def trained(spark, tables):
    return jobs.run_training(spark, f"{tables}/features", tables, TINY)


def test_feature_table_keeps_the_newest_rows(spark, tables):
    saved = read_features(spark, f"{tables}/features")
    assert saved.count() == 300 and len(saved.columns) == 148
    assert saved.where("target_temp_1h is null").count() == 2
    assert training.training_rows(saved).count() == 300 - 2 * 13
    assert len(training.feature_columns(saved)) == 144


def test_day_filter_prunes_the_scan(spark, tables, capsys):
    raw = read_raw(spark, f"{tables}/raw")
    as_of = datetime(2025, 6, 3)
    narrow = raw.select("city", "timestamp", "day", F.col("payload.current.rain").alias("humidity"))
    serving.statistics(narrow, "Madrid", 24, as_of).explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(day" in plan and "EqualTo(city,Madrid)" in plan
    assert "payload:struct<current:struct<rain:double>>>" in plan


def test_refresh_job_equals_full_job(spark, tables, tmp_path):
    raw, feats = str(tmp_path / "raw"), str(tmp_path / "features")
    rows = raw_table(spark, raw)
    jobs.run_features(spark, raw, feats)
    change = rows.where("city = 'Palma'").orderBy(F.col("timestamp")).limit(3)
    reading = F.when(F.hour("timestamp") > 0, 99.0)  # the first row loses its value
    hot = change.withColumn("payload", F.col("payload").withField("current.temperature_2m", reading))
    upsert(hot, raw)
    jobs.run_refresh(spark, raw, change.select("city", "timestamp"), feats)
    refreshed = read_features(spark, feats).orderBy("city", "timestamp").collect()
    jobs.run_features(spark, raw, str(tmp_path / "again"))
    again = read_features(spark, str(tmp_path / "again")).orderBy("city", "timestamp").collect()
    assert refreshed == again
    assert sum(r.temperature == 99.0 for r in refreshed) == 2
    saved = read_features(spark, feats)
    assert saved.count() == 300 and features.usable_rows(saved).count() == 299


def test_training_saves_registers_and_logs(spark, tables, trained):
    registry = read_days(spark, f"{tables}/model_registry").collect()
    assert sorted(r.model_name for r in registry) == sorted(t.name for t in trained)
    assert all(r.model_type == "PipelineModel" and len(r.version) == 15 for r in registry)
    runs = {r.model_type: r for r in read_days(spark, f"{tables}/training_runs").collect()}
    assert set(runs["temperature"].metrics) == {"rmse", "mae", "r2"}
    assert set(runs["rain"].metrics) == {"auc_roc", "auc_pr"}
    assert runs["rain"].params["cv_folds"] == "2"
    assert 0 < len(runs["temperature"].importances) <= 10
    weights = [i.weight for i in runs["temperature"].importances]
    assert weights == sorted(weights, reverse=True)


def test_scoring_is_keyed_and_reloads_the_model(spark, tables, trained):
    path = f"{tables}/predictions"
    for _ in range(2):
        assert jobs.run_scoring(spark, f"{tables}/features", tables, path) == 2
    saved = read_days(spark, path)
    rows = saved.collect()
    assert len(rows) == 2
    assert saved.drop("day", "part").columns == PREDICTIONS.names
    newest = datetime(2025, 6, 1) + timedelta(hours=149)
    for row in rows:
        assert row.source_timestamp == newest and row.horizon_hours == 1
        assert row.predicted_rain in (0.0, 1.0)
        assert row.temp_model_name.startswith("temp_prediction_1h_")
    model = trained[0].model
    direct = model.transform(read_features(spark, f"{tables}/features").where(F.col("timestamp") == newest))
    want = {r.city: r.predicted_temperature for r in direct.collect()}
    assert {r.city: r.predicted_temperature for r in rows} == pytest.approx(want)
    assert serving.latest_predictions(saved).count() == 2
    assert serving.city_predictions(saved, "Nowhere").count() == 0


def test_incomplete_rows_get_null_predictions(spark, tables, trained):
    feats = read_features(spark, f"{tables}/features").where("day_of_month = 3")
    holes = feats.withColumn("cape", F.when(F.col("city") == "Palma", F.col("cape")))
    entry = {"model_name": "m", "version": "v"}
    scored = scoring.score(holes, trained[0].model, entry)
    empty = F.count_if(F.col("predicted_temperature").isNull())
    missing = {r[0]: r[1] for r in scored.groupBy("city").agg(empty).collect()}
    assert missing["Palma"] == 0 and missing["Madrid"] == holes.where("city = 'Madrid'").count()
    assert scored.first().rain_model_name == "unknown"


def test_no_model_gives_an_empty_result(spark, tables, tmp_path):
    feats = read_features(spark, f"{tables}/features")
    scored = scoring.score_latest(spark, feats, str(tmp_path))
    assert scored.schema == PREDICTIONS and scored.isEmpty()
    assert jobs.run_scoring(spark, f"{tables}/features", str(tmp_path), str(tmp_path / "p")) == 0


def test_split_depends_on_keys_only(spark):
    rows = spark.range(5000).select(
        F.concat(F.lit("c"), F.col("id") % 7).alias("city"),
        F.timestamp_seconds(F.col("id") * 3600).alias("timestamp"),
    )
    parts = split.hash_split(rows, (0.6, 0.2, 0.2))
    again = split.hash_split(rows.repartition(13), (0.6, 0.2, 0.2))
    sizes = [p.count() for p in parts]
    assert sum(sizes) == 5000 and all(abs(a - b) < 150 for a, b in zip(sizes, (3000, 1000, 1000)))
    for part, other in zip(parts, again):
        assert part.exceptAll(other).isEmpty()


def test_areas_of_known_curves(spark):
    rows = [(1.0, 0.9), (1.0, 0.8), (0.0, 0.7), (1.0, 0.6), (0.0, 0.5), (0.0, 0.5)]
    areas = metrics.binary_areas(spark.createDataFrame(rows, "label double, score double"))
    assert areas["auc_roc"] == pytest.approx(8 / 9)
    perfect = spark.createDataFrame([(1.0, 0.9), (0.0, 0.1)], "label double, score double")
    assert metrics.binary_areas(perfect) == {"auc_roc": 1.0, "auc_pr": 1.0}


def test_regression_metrics_ignore_unknown_rows(spark):
    rows = [(1.0, 2.0), (3.0, 3.0), (5.0, None), (None, 1.0)]
    found = metrics.regression_metrics(spark.createDataFrame(rows, "label double, prediction double")).first()
    assert (found.mae, found.r2) == (0.5, 0.5) and found.rmse == pytest.approx(math.sqrt(0.5))


def test_importances_rank_absolute_coefficients(spark):
    rows = [(float(i), float(i % 3), 5.0 * i - (i % 3)) for i in range(30)]
    frame = spark.createDataFrame(rows, "a double, b double, target_temp_1h double")
    from pyspark.ml.regression import LinearRegression

    task = training.temperature_task()
    model = training.build_pipeline(task, LinearRegression, ["b", "a"]).fit(frame)
    assert [name for name, _ in training.importances(model)] == ["a", "b"]
