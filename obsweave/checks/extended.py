"""Queries over kept tables, joins in time, ranks, sketches and streams, with their SQL beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsweave.checks import oracle
from obsweave.checks.oracle import FORECASTS, NEWEST, OBS, SERVED, T, num, nums  # noqa: F401
from obsweave.checks.queries import (
    CITY,
    Query,
    base,
    daily,
    excess_rows,
    forecasts,
    number,
    numbers,
    predicted,
    rounded,
    served,
    snapshots,
    whole,
    zoneless,
)
from obsweave.checks.testbed import EVENT_MEASURES, double, observations, table
from obsweave.config import FeatureConfig
from obsweave.functions import columns as fn
from obsweave.operators import intervals, keyed, ranking, sketches
from obsweave.plans import evaluation, incremental, rollups, scoring, serving
from obsweave.session import scratch_path
from obsweave.sources import tables
from obsweave.streaming import dedup, live_features, windows

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def answered_by(sql: str):
    """Registers a query with the SQL that gives the same rows."""

    def register(query: Query) -> Query:
        QUERIES[query.__name__], SQL[query.__name__] = query, sql
        return query

    return register


def third(column: str = "timestamp"):
    """Rows in three parts that follow neither time nor station."""
    return F.pmod(F.xxhash64("city", column), F.lit(3))


# --- newest rows ------------------------------------------------------------


def kept_snapshots(spark, sf_dir) -> keyed.NewestTable:
    """Snapshots written in three batches out of order, the first one stale, and the table that follows them."""
    path = scratch_path(spark, "snapshots")
    newest = keyed.NewestTable(path + "_newest", order="sequence", parts=4)
    rows = snapshots(spark, sf_dir, spread=True).withColumn("sequence", F.lit(1))
    main = F.col("data.main").withField("temp", F.lit(-99.0))
    stale = rows.withColumn("data", F.col("data").withField("main", main)).withColumn("sequence", F.lit(0))
    for batch in (rows.where(third() == 2), stale.where(third() != 0), rows.where(third() != 2)):
        keyed.upsert(batch, path, order="sequence", newest=[newest])
    return newest


@answered_by(f"{SERVED} select * from snapshot where city = 'city_1' order by {T} desc limit 1")
def current_one_now(spark, sf_dir):
    return served(serving.current_now(kept_snapshots(spark, sf_dir), spark, CITY))


@answered_by(f"{OBS} select distinct city from obs")
def distinct_entities_now(spark, sf_dir):
    return serving.cities_now(kept_snapshots(spark, sf_dir), spark)


@answered_by(f"{SERVED} select * from snapshot {NEWEST}")
def latest_all_now(spark, sf_dir):
    return served(serving.current_all_now(kept_snapshots(spark, sf_dir), spark))


def kept_predictions(spark, sf_dir) -> keyed.NewestTable:
    """Predictions saved in three batches out of order, and the table that follows them."""
    path = scratch_path(spark, "predictions")
    # A prediction is keyed by its horizon, so every one has one.
    rows = forecasts(spark, sf_dir).withColumn("horizon_hours", F.coalesce("horizon_hours", F.lit(1)))
    for part in (1, 2, 0):
        scoring.save_predictions(rows.where(third("source_timestamp") == part), path)
    return scoring.newest_predictions(path)


@answered_by(
    f"""{FORECASTS} select * from forecasts qualify row_number() over
    (partition by city order by prediction_timestamp desc, source_timestamp desc) = 1"""
)
def predictions_latest_now(spark, sf_dir):
    return predicted(serving.latest_predictions_now(kept_predictions(spark, sf_dir), spark))


@answered_by(
    f"""{FORECASTS} select * from forecasts where city = 'city_1'
    order by prediction_timestamp desc, source_timestamp desc limit 24"""
)
def predictions_entity_now(spark, sf_dir):
    return predicted(serving.city_predictions_now(kept_predictions(spark, sf_dir), spark, CITY, 24))


# --- refresh ----------------------------------------------------------------


@answered_by("select (select count(*) from events) + (select count(distinct ts) from events) as rows, 0::bigint as differing")
def indexed_refresh(spark, sf_dir):
    """``refresh_equals_full`` through tables and the stored index, late rows in two batches."""
    obs_path, path = scratch_path(spark, "observed"), scratch_path(spark, "features")
    obs = observations(spark, sf_dir, "event_id")
    crowd = keyed.keep_newest(obs.withColumn("city", F.lit("all")), ["city", "timestamp"], "event_id")
    obs = obs.unionByName(crowd).drop("event_id")
    number_of = F.pmod(F.xxhash64("city", "timestamp"), F.lit(500))
    keyed.write_days(keyed.with_day(obs.where(number_of > 1)), obs_path, "overwrite")
    dense = FeatureConfig(frames="split")
    incremental.derive_features(keyed.read_days(spark, obs_path), path, dense)
    for late in (0, 1):
        keyed.write_days(keyed.with_day(obs.where(number_of == late)), obs_path, "append")
        spark.catalog.refreshByPath(obs_path)
        changed = obs.where(number_of == late).select("city", "timestamp")
        incremental.refresh_features(keyed.read_days(spark, obs_path), changed, path)
    refreshed = tables.read_features(spark, path)
    return excess_rows(incremental.build_features(obs, dense), refreshed)


# --- joins in time ----------------------------------------------------------

_REALISED = f"""{OBS}, forecasts as (
  select city, {T} as source_timestamp, temperature as predicted_temperature,
         {T} + to_hours(case when event_type <> 'view' then 3 else 1 end) as target_timestamp
  from obs
), evaluated as (
  select f.*, o.{T} as found, o.temperature as came
  from forecasts f asof left join obs o on f.city = o.city and f.target_timestamp <= o.{T}
), near as (
  select city, source_timestamp, target_timestamp, predicted_temperature,
         case when found <= target_timestamp + interval 24 hours then found end as realised_timestamp,
         case when found <= target_timestamp + interval 24 hours then came end as realised_temperature
  from evaluated
)"""


@answered_by(
    f"""{_REALISED} select city, source_timestamp, target_timestamp, realised_timestamp, {nums("realised_temperature")},
    {num("realised_temperature - predicted_temperature", "error")} from near"""
)
def realised_error(spark, sf_dir):
    """Every stored prediction with the first observation in the day after its target time."""
    found = evaluation.realised(forecasts(spark, sf_dir), observations(spark, sf_dir), tolerance_hours=24)
    times = ("source_timestamp", "target_timestamp", "realised_timestamp")
    return found.select("city", *[zoneless(t) for t in times], *numbers("realised_temperature", "error"))


@answered_by(
    f"""{_REALISED} select city, count(*) as predictions, count(realised_temperature) as realised,
    {num("sum(realised_temperature - predicted_temperature)", "total_error")},
    {num("sum(abs(realised_temperature - predicted_temperature))", "total_absolute_error")},
    {num("sqrt(avg((realised_temperature - predicted_temperature) ** 2))", "rmse")} from near group by city"""
)
def realised_summary(spark, sf_dir):
    found = evaluation.realised(forecasts(spark, sf_dir), observations(spark, sf_dir), tolerance_hours=24)
    summed = evaluation.error_summary(found, ("city",))
    # Sums of few decimals round alike on every engine, their means at a tie do not.
    totals = {"total_error": "bias", "total_absolute_error": "mae"}
    return summed.select(
        "city", "predictions", "realised", *[number(F.col(mean) * F.col("realised")).alias(c) for c, mean in totals.items()], *numbers("rmse")
    )


@answered_by(
    f"""{OBS}, outages as (
      select city, {T} as since, {T} + to_hours(case when event_id % 1000 = 0 then 2400
             else (event_id % 30)::int - 1 end) as until
      from obs where event_type = 'error'
    )
    select obs.city, obs.{T}, since, until, {num("temperature")}
    from obs join outages on obs.city = outages.city and obs.{T} between since and until"""
)
def outage_observations(spark, sf_dir):
    """Observations inside outages that errors open: some end before they start, some last for months."""
    obs = observations(spark, sf_dir, "event_id", "event_type")
    hours = F.when(F.col("event_id") % 1000 == 0, 2400).otherwise(F.col("event_id") % 30 - 1).cast("int")
    until = F.col("timestamp") + F.make_dt_interval(hours=hours)
    outages = obs.where("event_type = 'error'").select("city", F.col("timestamp").alias("since"), until.alias("until"))
    met = intervals.interval_join(obs, outages, start="since", end="until", name="outage")
    return met.select(
        "city",
        zoneless("timestamp"),
        F.col("outage.since").cast("timestamp_ntz").alias("since"),
        F.col("outage.until").cast("timestamp_ntz").alias("until"),
        *numbers("temperature"),
    )


# --- ranks, sketches, levels ------------------------------------------------


@answered_by(
    f"""with ranked as (
      select event_id, value, rank() over w as rank, percent_rank() over w as percent_rank,
             count(*) over (partition by value) as ties from events window w as (order by value)
    )
    select event_id, rank, {num("rank + (ties - 1) / 2", "average_rank")}, {num("percent_rank", digits=9)} from ranked"""
)
def global_rank(spark, sf_dir):
    """The rank of every event's value among all."""
    ranked = ranking.with_ranks(table(spark, sf_dir, "events").select("event_id", "value"), "value")
    return ranked.select("event_id", "rank", *numbers("average_rank"), *numbers("percent_rank", digits=9))


@answered_by(
    f"""with ranked as (
      select event_id, rank() over w as rank, percent_rank() over w as percent_rank,
             count(*) over (partition by event_type, json_extract_string(props, '$.k')::bigint) as ties
      from events window w as (partition by event_type order by json_extract_string(props, '$.k')::bigint desc)
    )
    select event_id, rank, {num("rank + (ties - 1) / 2", "average_rank")}, {num("percent_rank", digits=9)} from ranked"""
)
def grouped_rank(spark, sf_dir):
    """Ranks within event types by a number with many ties, greatest first."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    ranked = ranking.with_ranks(events, "k", ["event_type"], ascending=False)
    return ranked.select("event_id", "rank", *numbers("average_rank"), *numbers("percent_rank", digits=9))


@answered_by(oracle.ROC)
def roc_auc_by_rank(spark, sf_dir):
    scored = table(spark, sf_dir, "events").select(
        F.col("value").alias("score"), (F.col("event_type") == "error").cast("double").alias("label")
    )
    return ranking.auc_by_rank(scored).select(*numbers("auc_roc"))


def stored_sketches(spark, sf_dir) -> str:
    """Sketches of all days, some of them sketched again after late rows."""
    path, obs_path = scratch_path(spark, "sketches"), scratch_path(spark, "observed")
    obs, late = observations(spark, sf_dir), F.pmod(F.xxhash64("city", "timestamp"), F.lit(300)) == 0
    keyed.write_days(keyed.with_day(obs), obs_path, "overwrite")
    names = {"value": "temperature", "distinct": "weather_code"}
    sketches.refresh_sketches(keyed.with_day(obs.where(~late)), obs, path, **names)
    sketches.refresh_sketches(keyed.read_days(spark, obs_path), obs.where(late), path, **names)
    return path


@answered_by(
    f"""{OBS} select city, count(*) as n, count(distinct weather_code) as codes,
    {num("quantile_disc(temperature, 0.25)", "q25")}, {num("quantile_disc(temperature, 0.5)", "q50")},
    {num("quantile_disc(temperature, 0.75)", "q75")}
    from obs where {T} >= timestamp '2024-01-10' and {T} < timestamp '2024-01-20' group by city"""
)
def sketched_range(spark, sf_dir):
    """Quartiles and distinct codes of ten days per station, merged from daily sketches; exact, as few values merge."""
    days = sketches.in_days(spark, stored_sketches(spark, sf_dir), fn.instant("2024-01-10").cast("date"), fn.instant("2024-01-19").cast("date"))
    found = sketches.estimates(days)
    return found.select("city", "n", F.col("distinct").alias("codes"), *numbers("q25", "q50", "q75"))


@answered_by(
    f"""{OBS}, parted as (
      select city, date_trunc('hour', {T})::timestamp as h, date_trunc('day', {T})::timestamp as d,
             date_trunc('month', {T})::timestamp as m, temperature from obs
    )
    select case grouping_id(city, h, d, m) when 3 then 'hour' when 5 then 'day' when 6 then 'month'
                when 7 then 'city' else 'all' end as level,
           city, coalesce(h, d, m) as start, count(*) as rows, {num("avg(temperature)", "avg")},
           {num("stddev_samp(temperature)", "std")}, {num("min(temperature)", "min")}, {num("max(temperature)", "max")}
    from parted group by grouping sets ((city, h), (city, d), (city, m), (city), ())"""
)
def level_stats(spark, sf_dir):
    """Statistics per hour, day and month of each city, per city, and of all rows."""
    found = rollups.level_statistics(observations(spark, sf_dir))
    return found.select("level", "city", zoneless("start"), "rows", *numbers("avg", "std", "min", "max"))


# --- streams ----------------------------------------------------------------


def observed_stream(spark, sf_dir, *extra: str) -> DataFrame:
    """Observations as a stream of the event file, dealt out as one task reads a row group."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    events = events.repartition(spark.sparkContext.defaultParallelism).withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    return events.select(
        F.concat(F.lit("city_"), F.col("user_id").cast("string")).alias("city"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        *[double(text).alias(name) for name, text in EVENT_MEASURES.items()],
        *extra,
    )


def _final_windows(spark, found: DataFrame) -> DataFrame:
    path = scratch_path(spark, "windows")
    windows.start_windows(found, path, scratch_path(spark, "position"), availableNow=True).awaitTermination()
    rows = keyed.read_days(spark, path)
    return rows.select("city", zoneless("start"), zoneless("end"), *whole("rows"), *numbers("avg_temperature", "min_temperature", "max_temperature"))


# Windows are final once the greatest time, less two hours, has passed their end.
_STATS = f"""count(*) as rows, {num("avg(temperature)", "avg_temperature")},
    {num("min(temperature)", "min_temperature")}, {num("max(temperature)", "max_temperature")}"""
_FINAL = f"(select date_trunc('millisecond', max({T})) - interval 2 hours from obs)"


@answered_by(
    f"""{OBS}, placed as (select *, date_trunc('hour', {T})::timestamp as start from obs)
    select city, start, start + interval 1 hour as "end", {_STATS} from placed
    where start + interval 1 hour <= {_FINAL} group by city, start"""
)
def stream_tumbling(spark, sf_dir):
    return _final_windows(spark, windows.tumbling(observed_stream(spark, sf_dir)))


@answered_by(
    f"""{OBS}, placed as (
      select *, date_trunc('hour', {T})::timestamp - to_hours(i::int) as start from obs, unnest(range(6)) as steps(i)
    )
    select city, start, start + interval 6 hours as "end", {_STATS} from placed
    where start + interval 6 hours <= {_FINAL} group by city, start"""
)
def stream_sliding(spark, sf_dir):
    return _final_windows(spark, windows.sliding(observed_stream(spark, sf_dir)))


@answered_by(
    f"""{OBS}, breaks as (
      select *, coalesce({T} - lag({T}) over (partition by city order by {T}) >= interval 3 hours, true)::int as fresh from obs
    ), runs as (select *, sum(fresh) over (partition by city order by {T}) as run from breaks)
    select city, min({T}) as start, max({T}) + interval 3 hours as "end", {_STATS} from runs
    group by city, run having max({T}) + interval 3 hours <= {_FINAL}"""
)
def stream_sessions(spark, sf_dir):
    return _final_windows(spark, windows.sessions(observed_stream(spark, sf_dir)))


@answered_by("select event_id, user_id, ts as received_at, value from events")
def stream_first_wins(spark, sf_dir):
    """Events that come three times each, kept once."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    again = events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("received_at"), "value", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("copy"))
    path = scratch_path(spark, "first")
    dedup.start_first_wins(again.drop("copy"), path, scratch_path(spark, "position"), ["event_id"], availableNow=True).awaitTermination()
    return keyed.read_days(spark, path).select("event_id", "user_id", zoneless("received_at"), "value")


_LIVE = oracle.lags() | oracle.rolling("mean", "std", "min", "max") | oracle.RAIN_SUM | oracle.DELTAS
_LIVE_SHOWN = ("temperature_lag_1h", "pressure_lag_12h", "precipitation_lag_3h", "temperature_mean_6h", "humidity_std_24h", "shortwave_radiation_max_12h", "precip_sum_6h", "temp_change_1h", "humidity_change_1h")


@answered_by(
    f"""{OBS}, derived as (
      select city, {T}, temperature, {", ".join(f"{_LIVE[c]} as {c}" for c in _LIVE_SHOWN)} from base
    )
    select city, {T}, {nums("temperature", *_LIVE_SHOWN)} from derived
    where date_trunc('day', {T}) + interval 1 day < {_FINAL}"""
)
def stream_features(spark, sf_dir):
    """Feature columns of a stream by keyed state; a day comes out when the watermark has passed it."""
    live_features.use_state_store(spark)
    from obsweave.plans.features import with_physics

    path = scratch_path(spark, "live")
    found = live_features.live_features(with_physics(observed_stream(spark, sf_dir)), every_hours=24, config=FeatureConfig())
    query = found.writeStream.format("parquet").outputMode("append").option("checkpointLocation", scratch_path(spark, "position"))
    query.option("path", path).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(found.schema).parquet(path)
    return rows.select("city", zoneless("timestamp"), *[rounded(c) for c in ("temperature", *_LIVE_SHOWN)])
