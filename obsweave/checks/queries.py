"""Every operator as a query over the provided tables, through the library's functions.

Results carry plain types only (strings, bigint, double, zoneless times), with
computed doubles rounded, so they compare by value with another engine.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime
from functools import reduce

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from obsweave.checks.testbed import observations, table
from obsweave.config import FeatureConfig, TrainingConfig
from obsweave.functions import columns as fn
from obsweave.operators import explode, keyed, latest, metrics, split
from obsweave.plans import features, incremental, scoring, serving, training
from obsweave.schemas import MEASURE_PATHS, MEASURES
from obsweave.session import scratch_path
from obsweave.sources import backfill, messages, tables
from obsweave.streaming import ingest

AS_OF = datetime(2024, 1, 30)
SCORED_AT = datetime(2024, 2, 1)
HOURS = 168
CITY, OTHER_CITIES = "city_1", "city_1, city_2, city_3,city_4"
LAST_DAY = datetime(2024, 1, 29)
PREFIX = "temp_prediction_1h"

Query = Callable[[SparkSession, str], DataFrame]


def number(column: str | Column, digits: int = 6) -> Column:
    """A double rounded for comparison, in arithmetic every engine does alike."""
    column = F.col(column) if isinstance(column, str) else column
    scale = F.lit(10.0**digits)
    return F.floor(column.cast("double") * scale + F.lit(0.5)) / scale


def numbers(*names: str, digits: int = 6) -> list[Column]:
    return [number(name, digits).alias(name) for name in names]


def zoneless(column: str) -> Column:
    return F.col(column).cast("timestamp_ntz").alias(column)


def whole(*names: str) -> list[Column]:
    return [F.col(name).cast("bigint").alias(name) for name in names]


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.with_physics(observations(spark, sf_dir))


# --- scans, decode, encode, keyed writes ---------------------------------


def scan_obs(spark, sf_dir):
    return observations(spark, sf_dir).select("city", zoneless("timestamp"), *numbers(*MEASURES))


def scan_features(spark, sf_dir):
    path = scratch_path(spark, "features")
    derived = features.with_calendar(base(spark, sf_dir))
    keyed.write_days(keyed.with_day(derived), path, "overwrite")
    return tables.read_features(spark, path).select(
        "city", zoneless("timestamp"), *numbers(*MEASURES), *whole("hour", "month")
    )


def live_messages(spark, sf_dir) -> DataFrame:
    """Events as live JSON messages."""
    paths = {path.split(".")[1]: name for name, path in MEASURE_PATHS.items() if "." in path}
    current = F.struct(
        F.unix_timestamp("timestamp").alias("time"),
        *[F.col(name).alias(reading) for reading, name in paths.items()],
    )
    obs = observations(spark, sf_dir).withColumn("current", current)
    return messages.encode(obs, columns=["city", "latitude", "longitude", "current"])


def ingest_parse(spark, sf_dir):
    parsed = messages.parse(live_messages(spark, sf_dir))
    flat = tables.flatten(parsed.where("valid"), "time_status")
    return flat.select("city", zoneless("timestamp"), *numbers(*MEASURES), "time_status")


def json_props(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "props")
    decoded = messages.decoded(events, "k bigint, _bad string", "props", "p")
    return decoded.select("event_id", F.col("p.k").alias("k"), F.col("p._bad").isNull().alias("ok"))


def ingest_whitespace(spark, sf_dir):
    """Messages with white space around them, cut-off ones and arrays: what the ingest takes."""
    live = live_messages(spark, sf_dir).withColumn("n", F.xxhash64("value"))
    numbered = live.withColumn("at", F.get_json_object("value", "$.current.time").cast("bigint"))
    kind = F.col("at") % 4
    value = (
        F.when(kind == 0, F.concat(F.lit("\n\t "), "value", F.lit(" \r\n")))
        .when(kind == 1, F.concat(F.lit("["), "value", F.lit("]")))
        .when(kind == 2, F.expr("substring(value, 1, length(value) - 1)"))
        .otherwise(F.col("value"))
    )
    parsed = messages.parse(numbered.select(value.alias("value")))
    return parsed.where("valid").select("city", zoneless("timestamp"), number("payload.current.temperature_2m").alias("temp"))


def backfill_expand(spark, sf_dir):
    """Events as one historical payload per user; an hour far outside the calendar falls."""
    hour = F.struct(
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("time"), (F.col("value") / 10).alias("temperature_2m")
    )
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(hour)).alias("hours"))
    absurd = F.array(F.lit(10**15).cast("bigint"))
    series = F.struct(
        F.concat(F.col("hours.time"), absurd).alias("time"), F.col("hours.temperature_2m").alias("temperature_2m")
    )
    name = F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("city_"), "user_id"))
    payloads = users.select(F.to_json(F.struct(name.alias("city"), series.alias("hourly"))).alias("value"))
    rows = backfill.expand(backfill.parse_payloads(payloads))
    return rows.select("city", zoneless("timestamp"), number("payload.current.temperature_2m").alias("temp"))


def json_encode(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return messages.encode(events, "user_id", ["event_id", "event_type", "value"])


def daily(spark, sf_dir) -> DataFrame:
    """Events keyed by city and day, several per key."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("city_"), "user_id").alias("city"),
        F.date_trunc("day", F.col("ts").cast("timestamp")).alias("timestamp"),
        "event_type",
        "value",
        "event_id",
    )


def upsert_last_wins(spark, sf_dir):
    path = scratch_path(spark, "upsert")
    writes = daily(spark, sf_dir)
    keyed.upsert(writes.withColumn("value", F.lit(-1.0)), path, order="event_id")
    keyed.upsert(writes, path, order="event_id")
    return keyed.read_days(spark, path).select("city", zoneless("timestamp"), "value", "event_id")


def insert_if_absent(spark, sf_dir):
    path = scratch_path(spark, "insert")
    rows = daily(spark, sf_dir)
    keyed.upsert(rows.where("event_type = 'error'"), path, order="event_id")
    inserted, skipped = keyed.insert_if_absent(rows, path, order="event_id")
    return keyed.read_days(spark, path).select(
        "city",
        zoneless("timestamp"),
        "value",
        "event_type",
        F.lit(inserted).cast("bigint").alias("inserted"),
        F.lit(skipped).cast("bigint").alias("skipped"),
    )


def key_exists(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").withColumn("key", F.col("c_custkey"))
    ordered = table(spark, sf_dir, "orders").withColumn("key", F.col("o_custkey"))
    return keyed.present_rows(ordered, customers, ["key"]).select("c_custkey", "c_name")


def explode_series(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: i * 3600).alias("time"),
        F.col("embedding").cast("array<double>").alias("full"),
        F.slice(F.col("embedding").cast("array<double>"), 1, 10).alias("short"),
        F.lit(None).cast("array<double>").alias("absent"),
    )
    rows = explode.explode_series(vectors, "time", ["full", "short", "absent"], keep=["vec_id"])
    return rows.select("vec_id", *whole("time"), *numbers("full", "short", "absent"))


# --- projections ----------------------------------------------------------


def nested(spark, sf_dir, *extra: str, spread: bool = False) -> DataFrame:
    """Observations in the raw nested shape."""
    paths = {path: name for name, path in MEASURE_PATHS.items()}
    current = [
        F.col(name).alias(path.split(".")[1]) for path, name in paths.items() if "." in path
    ]
    absent = [F.lit(None).cast("double").alias(name) for name in ("showers", "uv_index", "is_day")]
    payload = F.struct(F.struct(*current, *absent).alias("current"), "latitude", "longitude")
    return observations(spark, sf_dir, *extra, spread=spread).select(
        "city", "timestamp", payload.alias("payload"), *extra
    )


def flatten_obs(spark, sf_dir):
    text_times = nested(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("string"))
    flat = tables.flatten(text_times)
    return flat.select("city", zoneless("timestamp"), *numbers(*MEASURES))


def snapshots(spark, sf_dir, spread: bool = False) -> DataFrame:
    """Observations as nested current snapshots."""
    raw = nested(spark, sf_dir, spread=spread)
    return raw.select("city", "timestamp", ingest.snapshot_data().alias("data"))


def snapshot_nest(spark, sf_dir):
    return snapshots(spark, sf_dir).select(
        "city",
        zoneless("timestamp"),
        number("data.main.temp").alias("temp"),
        number("data.main.sea_level").alias("sea_level"),
        number("data.wind.deg").alias("deg"),
        number("data.clouds.all").alias("clouds"),
        F.col("data.weather")[0]["id"].cast("bigint").alias("code"),
        F.col("data.weather")[0]["description"].alias("description"),
        number("data.uv_index").alias("uv_index"),
    )


def coalesce_nested(spark, sf_dir):
    """A table with some top-level values beside the nested ones."""
    events = observations(spark, sf_dir, "event_type").select(
        "city",
        "timestamp",
        F.when(F.col("event_type") == "view", F.col("temperature") + 100).alias("temperature"),
        F.struct(
            F.struct(
                F.col("temperature").alias("temp"), "feels_like", "humidity", "pressure"
            ).alias("main"),
            F.struct(F.col("wind_speed").alias("speed")).alias("wind"),
            F.array(
                F.struct(F.when(F.col("event_type") != "error", F.col("event_type")).alias("description"))
            ).alias("weather"),
        ).alias("data"),
    )
    return served(serving.readings(events))


def served(rows: DataFrame) -> DataFrame:
    return rows.select(
        "city", *numbers(*serving.SNAPSHOT_PATHS), "description", zoneless("timestamp")
    )


def composite_key(spark, sf_dir):
    obs = observations(spark, sf_dir)
    key = fn.composite_key(F.col("city"), F.col("timestamp"))
    return obs.select(key.alias("id"), zoneless("timestamp"))


def code_lookup(spark, sf_dir):
    obs = observations(spark, sf_dir, "event_id")
    return obs.select(
        "event_id", *whole("weather_code"), fn.code_text(F.col("weather_code")).alias("description")
    )


def specific_humidity(spark, sf_dir):
    return base(spark, sf_dir).select(
        "city", zoneless("timestamp"), *numbers("specific_humidity", digits=9)
    )


def wind_components(spark, sf_dir):
    return base(spark, sf_dir).select("city", zoneless("timestamp"), *numbers("wind_u", "wind_v"))


def time_features(spark, sf_dir):
    parts = ("hour", "day_of_week", "day_of_month", "month", "quarter")
    return features.with_calendar(observations(spark, sf_dir)).select(
        "city", zoneless("timestamp"), *whole(*parts)
    )


def cyclic_features(spark, sf_dir):
    return features.with_calendar(observations(spark, sf_dir)).select(
        "city", zoneless("timestamp"), *numbers("hour_sin", "hour_cos", "month_sin", "month_cos")
    )


def unix_time(spark, sf_dir):
    """Text seconds back to a time; views have no time, errors an unusable one."""
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string")
    text = F.when(F.col("event_type") == "error", F.concat(seconds, F.lit(".0"))).otherwise(seconds)
    absent = F.col("event_type") == "view"
    parsed = text.try_cast("bigint")
    now = fn.instant(SCORED_AT)
    return table(spark, sf_dir, "events").select(
        "event_id",
        fn.seconds_to_time(parsed, absent, now).cast("timestamp_ntz").alias("timestamp"),
        fn.time_status(parsed, absent).alias("time_status"),
    )


def version_tag(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", fn.version_tag(F.col("ts")).alias("version")
    )


def hash_split(spark, sf_dir):
    parts = split.hash_split(table(spark, sf_dir, "events"), (0.6, 0.2, 0.2), ("event_id", "user_id"), seed=42)
    named = [p.select("event_id", F.lit(n).alias("part")) for p, n in zip(parts, ("train", "validation", "test"))]
    return reduce(DataFrame.union, named)


# --- window features ------------------------------------------------------


def _derived(
    spark, sf_dir, group: str, names: Sequence[str] | None = None, config: FeatureConfig = FeatureConfig()
) -> DataFrame:
    start = base(spark, sf_dir)
    names = names or features.feature_order(start.columns, config, (group,))
    rows = features.windowed_features(start, config, groups=(group,))
    return rows.select("city", zoneless("timestamp"), *[rounded(name) for name in names])


def rounded(name: str) -> Column:
    digits = 9 if name.startswith("specific_humidity") else 6
    return number(name, digits).alias(name)


def _rolling(stat: str) -> list[str]:
    config = FeatureConfig()
    return [
        features.rolling_name(c, s, h)
        for h in config.rolling_hours
        for c in features.ROLLED
        for s in stat.split("|")
    ]


def lag_features(spark, sf_dir):
    return _derived(spark, sf_dir, "lag")


def rolling_mean(spark, sf_dir):
    return _derived(spark, sf_dir, "rolling", _rolling("mean"))


def rolling_std(spark, sf_dir):
    return _derived(spark, sf_dir, "rolling", _rolling("std"))


def rolling_minmax(spark, sf_dir):
    return _derived(spark, sf_dir, "rolling", _rolling("min|max"))


def rolling_sum(spark, sf_dir):
    return _derived(spark, sf_dir, "rolling", ["precip_sum_6h"])


def rolling_dense(spark, sf_dir):
    """All rolling statistics by split frames, the way dense series take."""
    return _derived(spark, sf_dir, "rolling", config=FeatureConfig(frames="split"))


def resample_hour(spark, sf_dir):
    """The last observation of each city and hour, with lags that count hours with any."""
    built = features.build_features(observations(spark, sf_dir), FeatureConfig(resample="hour"))
    return built.select("city", zoneless("timestamp"), *numbers("temperature", "temperature_lag_1h", "temp_change_1h"))


def delta_features(spark, sf_dir):
    return _derived(spark, sf_dir, "delta")


def lead_target(spark, sf_dir):
    rows = _derived(spark, sf_dir, "target")
    return rows.withColumn("target_will_rain_1h", F.col("target_will_rain_1h").cast("bigint"))


def feature_rows(built: DataFrame) -> DataFrame:
    """The 148-column feature row, rounded for comparison."""
    integers = {"hour", "day_of_week", "day_of_month", "month", "quarter", "target_will_rain_1h"}
    return built.select(
        "city",
        zoneless("timestamp"),
        *[
            F.col(c).cast("bigint").alias(c) if c in integers else rounded(c)
            for c in built.columns
            if c not in ("city", "timestamp")
        ],
    )


def feature_frame(spark, sf_dir):
    return feature_rows(features.build_features(observations(spark, sf_dir)))


def incremental_features(spark, sf_dir):
    """A saved feature table refreshed, through its files, for the last days and late rows of all others."""
    path, obs_path = scratch_path(spark, "refreshed"), scratch_path(spark, "observed")
    obs = observations(spark, sf_dir)
    late = (F.col("timestamp") >= fn.instant(LAST_DAY)) | (F.pmod(F.xxhash64("city", "timestamp"), F.lit(400)) == 0)
    keyed.write_days(keyed.with_day(obs), obs_path, "overwrite")
    # A station of a large table is read many times an hour.
    incremental.derive_features(obs.where(~late), path, FeatureConfig(frames="split"))
    saved = keyed.read_days(spark, obs_path)
    incremental.refresh_features(saved, obs.where(late).select("city", "timestamp"), path)
    return feature_rows(tables.read_features(spark, path))


def refresh_equals_full(spark, sf_dir):
    """A dense station and thin ones refreshed for late rows: rows that differ from a full derivation, unrounded."""
    obs = observations(spark, sf_dir, "event_id")
    crowd = latest.newest_row(obs.withColumn("city", F.lit("all")), ["city", "timestamp"], "event_id")
    obs = obs.unionByName(crowd).drop("event_id")
    late = F.pmod(F.xxhash64("city", "timestamp"), F.lit(500)) == 0
    dense = FeatureConfig(frames="split")
    stale = features.build_features(obs.where(~late), dense)
    refreshed = incremental.Refresh(obs, obs.where(late).select("city", "timestamp"), dense).replaced(stale)
    return excess_rows(features.build_features(obs, dense), refreshed)


def excess_rows(full: DataFrame, other: DataFrame) -> DataFrame:
    """The rows of ``full``, and how many rows only one of the two has; each is evaluated once.

    Rows meet by their key and two 64-bit digests of all columns, taken from the first
    to the last and from the last to the first, so that a tenth of a row is shuffled.  As the key
    itself is compared, a difference stays hidden only if both digests of two
    rows of one key agree by chance.  Nulls count by their place, as a digest passes over them.
    """
    sides = full.withColumn("_side", F.lit(1)).unionByName(other.select(*full.columns).withColumn("_side", F.lit(-1)))
    held = [item for c in full.columns for item in (F.isnull(c), F.col(c))]
    digests = [F.xxhash64(*held).alias("_there"), F.xxhash64(*held[::-1]).alias("_back")]
    met = (
        sides.select("city", "timestamp", *digests, "_side")
        .groupBy("city", "timestamp", "_there", "_back")
        .agg(F.sum("_side").alias("excess"), F.count_if(F.col("_side") > 0).alias("rows"))
    )
    return met.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in (("rows", "rows"), ("differing", F.abs("excess")))])


FLAGSHIP = (
    "temperature",
    "temperature_lag_1h",
    "temperature_mean_6h",
    "temp_change_1h",
    "precip_sum_6h",
)


def latest_features(spark, sf_dir):
    """Newest feature row per city: the flagship."""
    built = features.build_features(observations(spark, sf_dir))
    newest = latest.newest_row(built.select("city", "timestamp", *FLAGSHIP))
    return newest.select("city", zoneless("timestamp"), *numbers(*FLAGSHIP))


def dropna_essential(spark, sf_dir):
    built = features.windowed_features(base(spark, sf_dir), groups=("target",))
    return features.complete_rows(built).select(
        "city", zoneless("timestamp"), *numbers("temperature", "target_temp_1h")
    )


def dropna_any(spark, sf_dir):
    built = features.build_features(observations(spark, sf_dir))
    kept = ("temperature_lag_12h", "temperature_std_6h", "target_temp_1h")
    return training.training_rows(built).select("city", zoneless("timestamp"), *numbers(*kept))


def global_summary(spark, sf_dir):
    summed = features.summary(base(spark, sf_dir))
    return summed.select(
        *numbers("avg_temp", "std_temp", "avg_humidity", "avg_wind_speed"),
        *numbers("avg_specific_humidity", digits=9),
    )


def row_counts(spark, sf_dir):
    """Rows that a feature job has written, and those of them with a target."""
    path = scratch_path(spark, "counted")
    built = features.windowed_features(base(spark, sf_dir), groups=("target",))
    seen = keyed.write_counted(keyed.with_day(built), path, usable=F.col("target_temp_1h").isNotNull())
    return spark.range(1).select(*[F.lit(seen[name]).cast("bigint").alias(name) for name in ("rows", "usable")])


# --- latest rows and reads ------------------------------------------------


def latest_join(spark, sf_dir):
    """Newest day per city with every row of that day."""
    return latest.newest_rows(daily(spark, sf_dir)).select(
        "city", zoneless("timestamp"), "event_id", "value"
    )


def latest_rownum(spark, sf_dir):
    newest = latest.newest_row(daily(spark, sf_dir), tie_break=[F.col("event_id").desc()])
    return newest.select("city", zoneless("timestamp"), "event_id", "value")


def city_filter(spark, sf_dir):
    rows = serving.of_city(observations(spark, sf_dir), CITY)
    return rows.select("city", zoneless("timestamp"), *numbers("temperature"))


def current_one(spark, sf_dir):
    return served(serving.current(snapshots(spark, sf_dir), CITY))


def distinct_entities(spark, sf_dir):
    return serving.cities(observations(spark, sf_dir))


def latest_all(spark, sf_dir):
    return served(serving.current_all(snapshots(spark, sf_dir)))


def historical_range(spark, sf_dir):
    return served(serving.history(snapshots(spark, sf_dir), CITY, HOURS, 1000, AS_OF))


def period_stats(spark, sf_dir):
    stats = serving.statistics(snapshots(spark, sf_dir), hours=HOURS, as_of=AS_OF, digits=None)
    averages = [c for c in stats.columns if c.startswith(("avg_", "min_", "max_"))]
    return stats.select(
        "city",
        *numbers(*averages),
        *whole("total_records", "period_hours"),
        zoneless("start_time"),
        zoneless("end_time"),
    )


def compare_entities(spark, sf_dir):
    compared = serving.compare(snapshots(spark, sf_dir), OTHER_CITIES, HOURS, AS_OF, digits=None)
    averages = [c for c in compared.columns if c.startswith("avg_")]
    return compared.select("city", *numbers(*averages), *whole("data_points", "period_hours"))


def forecasts(spark, sf_dir) -> DataFrame:
    """Predictions that repeat the current value, made a day after each observation."""
    return observations(spark, sf_dir, "event_type").select(
        "city",
        F.col("timestamp").alias("source_timestamp"),
        F.date_trunc("day", "timestamp").alias("prediction_timestamp"),
        F.col("temperature").alias("predicted_temperature"),
        F.when(F.col("rain") > 0, 1.0).otherwise(0.0).alias("predicted_rain"),
        F.col("temperature").alias("observed_temperature"),
        F.when(F.col("event_type") != "view", 3).alias("horizon_hours"),
        F.lit(PREFIX).alias("temp_model_name"),
        fn.version_tag(F.col("timestamp")).alias("temp_model_version"),
        F.lit("unknown").alias("rain_model_name"),
        F.lit("unknown").alias("rain_model_version"),
    )


def predicted(rows: DataFrame) -> DataFrame:
    return rows.select(
        "city",
        zoneless("source_timestamp"),
        zoneless("prediction_timestamp"),
        *numbers("predicted_temperature", "predicted_rain", "observed_temperature", digits=4),
        *whole("horizon_hours"),
        "temp_model_name",
        "temp_model_version",
        "rain_model_name",
        "rain_model_version",
    )


def predictions_latest(spark, sf_dir):
    return predicted(serving.latest_predictions(forecasts(spark, sf_dir)))


def predictions_entity(spark, sf_dir):
    return predicted(serving.city_predictions(forecasts(spark, sf_dir), CITY, 24))


def registry_latest(spark, sf_dir):
    """Events as registered models: purchases are temperature models, others are not."""
    events = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", PREFIX).otherwise("rain_prediction_1h")
    registry = events.select(
        F.concat_ws("_", kind, "user_id").alias("model_name"),
        F.concat(F.lit("/models/"), "event_id").alias("path"),
        F.col("ts").alias("timestamp"),
        fn.version_tag(F.col("ts")).alias("version"),
    )
    return training.latest_entry(registry, PREFIX)


# --- metrics, training, scoring -------------------------------------------


def persistence(spark, sf_dir) -> DataFrame:
    """The current values as forecasts of the next row's."""
    built = features.windowed_features(base(spark, sf_dir), groups=("target",))
    return built.select(
        "city",
        "timestamp",
        "temperature",
        F.col("target_temp_1h").alias("label"),
        F.col("temperature").alias("prediction"),
        F.col("target_will_rain_1h").cast("bigint").alias("rain_label"),
        F.when(F.col("rain") > 0, 1).otherwise(0).cast("bigint").alias("rain_prediction"),
    )


def abs_error(spark, sf_dir):
    return metrics.with_error(persistence(spark, sf_dir)).select(
        "city", zoneless("timestamp"), *numbers("label", "prediction", "error")
    )


def regression_metrics(spark, sf_dir):
    return metrics.regression_metrics(persistence(spark, sf_dir)).select(numbers("rmse", "mae", "r2"))


def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(persistence(spark, sf_dir), "rain_label", "rain_prediction")


def _areas(spark, sf_dir, name: str) -> DataFrame:
    labelled = table(spark, sf_dir, "events").select(
        F.col("value").alias("score"),
        (F.col("event_type") == "error").cast("double").alias("label"),
    )
    areas = metrics.binary_areas(labelled)
    return spark.createDataFrame([(areas[name],)], f"{name} double").select(numbers(name))


def roc_auc(spark, sf_dir):
    return _areas(spark, sf_dir, "auc_roc")


def pr_auc(spark, sf_dir):
    return _areas(spark, sf_dir, "auc_pr")


def labelled(spark, sf_dir) -> DataFrame:
    built = features.windowed_features(base(spark, sf_dir), groups=("target",))
    return training.training_rows(built).select(
        "city", "timestamp", "temperature", *features.target_columns()
    )


def _fit_line(rows: DataFrame):
    pipeline = training.build_pipeline(
        training.temperature_task(), LinearRegression, ["temperature"]
    )
    rows = rows.persist()
    try:
        return pipeline.fit(rows)
    finally:
        rows.unpersist()


def train_regression(spark, sf_dir):
    """Ordinary least squares of the target on the current temperature."""
    rows = labelled(spark, sf_dir)
    fitted = _fit_line(rows)
    _, scaler, line = fitted.stages
    slope = line.coefficients[0] / scaler.std[0]
    found = [(float(line.intercept), float(slope), int(line.summary.numInstances))]
    result = spark.createDataFrame(found, "intercept double, slope double, n bigint")
    return result.select(*numbers("intercept", "slope", digits=4), "n")


def separable(spark, sf_dir) -> DataFrame:
    """Rows with their rain target and, as the one feature, whether the next row brings rain: one split tells all."""
    temp, rain = features.target_columns()
    built = features.windowed_features(base(spark, sf_dir), groups=("target",))
    return built.select("city", "timestamp", F.col(rain).cast("double").alias("wet"), temp, rain)


def train_classification(spark, sf_dir):
    """The cross-validated choice of the rain families: its areas, and each family's predictions of every row."""
    temp, rain = features.target_columns()
    small = TrainingConfig(
        folds=2,
        classification_grids={
            "GradientBoostedTrees": {"maxDepth": [1], "maxIter": [2], "stepSize": [0.1]},
            "RandomForest": {"numTrees": [3], "maxDepth": [1], "minInstancesPerNode": [1]},
        },
    )
    rows = separable(spark, sf_dir).dropna().persist()
    try:
        done = training.train(rows, training.rain_task(), small)
        areas = [F.lit(done.metrics[name]).cast("double").alias(name) for name in ("auc_roc", "auc_pr")]
        found = []
        for family in (GBTClassifier, RandomForestClassifier):
            pipeline = training.build_pipeline(training.rain_task(), family, ["wet"])
            pipeline.getStages()[-1].setMaxDepth(1).setSeed(1)
            scored = pipeline.fit(rows).transform(rows)
            counts = scored.groupBy(F.col(rain).cast("bigint").alias("label"), F.col("predicted_rain").cast("bigint").alias("prediction")).count()
            found.append(counts.withColumn("family", F.lit(family.__name__)).checkpoint())
    finally:
        rows.unpersist()
    return reduce(DataFrame.union, found).withColumns({a: number(c) for a, c in zip(("auc_roc", "auc_pr"), areas)})


def score_shape(spark, sf_dir):
    """Scoring without any model: provenance unknown, predictions null."""
    newest = latest.newest_row(observations(spark, sf_dir))
    return predicted(scoring.score(newest, as_of=fn.instant(SCORED_AT)))


def score_batch(spark, sf_dir):
    """The newest row per city scored by a line fitted on all rows."""
    entry = Row(model_name=f"{PREFIX}_LinearRegression", version="20240201_000000")
    newest = latest.newest_row(observations(spark, sf_dir))
    model = _fit_line(labelled(spark, sf_dir))
    return predicted(scoring.score(newest, model, entry, as_of=fn.instant(SCORED_AT)))


def score_both(spark, sf_dir):
    """Both models on the same rows, the rain model a forest of one split on whether it rains now."""
    wet = F.when(F.col("rain") > 0, 1.0).otherwise(0.0)
    taught = separable(spark, sf_dir)
    forest = training.build_pipeline(training.rain_task(), RandomForestClassifier, ["wet"])
    forest.getStages()[-1].setNumTrees(3).setMaxDepth(1).setSeed(1)
    rain_model = forest.fit(taught)
    newest = latest.newest_row(observations(spark, sf_dir)).withColumn("wet", wet)
    scored = scoring.score(
        newest,
        _fit_line(labelled(spark, sf_dir)),
        Row(model_name=f"{PREFIX}_LinearRegression", version="1"),
        rain_model,
        Row(model_name="rain_prediction_1h_RandomForest", version="1"),
        as_of=fn.instant(SCORED_AT),
    )
    return predicted(scored)


# --- streaming ------------------------------------------------------------


def stream_upsert(spark, sf_dir):
    """Events as a message stream through the live ingest, read back from its table."""
    schema = table(spark, sf_dir, "events").schema
    events = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    )
    where = ingest.Tables.under(scratch_path(spark, "stream"))
    values = events.select(
        F.to_json(
            F.struct(
                F.concat(F.lit("city_"), "user_id").alias("city"),
                F.struct(
                    # One key a city and day, so keys repeat.
                    F.unix_timestamp(F.date_trunc("day", F.col("ts").cast("timestamp"))).alias("time"),
                    (F.col("value") / 10).alias("temperature_2m"),
                    F.get_json_object("props", "$.k").cast("int").alias("weather_code"),
                ).alias("current"),
            )
        ).alias("value"),
        F.col("ts").cast("timestamp").alias("received_at"),
        # Offsets run against time, as those of two topic partitions may.
        messages.sequence(F.col("ts").cast("timestamp"), F.col("event_id") % 3, -F.col("event_id")),
    )
    query = ingest.start_ingest(values, where, scratch_path(spark, "position"), availableNow=True)
    query.awaitTermination()
    snapshots = tables.read_table(spark, where.current)
    return snapshots.select(
        "id",
        "city",
        zoneless("timestamp"),
        number("data.main.temp").alias("temp"),
        F.col("data.weather")[0]["description"].alias("description"),
    )


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        scan_obs,
        scan_features,
        ingest_parse,
        ingest_whitespace,
        backfill_expand,
        json_props,
        json_encode,
        upsert_last_wins,
        insert_if_absent,
        key_exists,
        explode_series,
        flatten_obs,
        snapshot_nest,
        coalesce_nested,
        composite_key,
        code_lookup,
        specific_humidity,
        wind_components,
        time_features,
        cyclic_features,
        unix_time,
        version_tag,
        hash_split,
        lag_features,
        rolling_mean,
        rolling_std,
        rolling_minmax,
        rolling_sum,
        rolling_dense,
        delta_features,
        lead_target,
        feature_frame,
        incremental_features,
        refresh_equals_full,
        resample_hour,
        latest_features,
        dropna_essential,
        dropna_any,
        global_summary,
        row_counts,
        latest_join,
        latest_rownum,
        city_filter,
        current_one,
        distinct_entities,
        latest_all,
        historical_range,
        period_stats,
        compare_entities,
        predictions_latest,
        predictions_entity,
        registry_latest,
        abs_error,
        regression_metrics,
        confusion_matrix,
        roc_auc,
        pr_auc,
        train_regression,
        train_classification,
        score_shape,
        score_batch,
        score_both,
        stream_upsert,
    )
}
