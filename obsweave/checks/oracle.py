"""The same answers as plain SQL for another engine, over the provided tables."""

from __future__ import annotations

from obsweave.checks.testbed import EVENT_MEASURES

T = '"timestamp"'
AS_OF, SCORED_AT = "timestamp '2024-01-30'", "timestamp '2024-02-01'"
PREFIX = "temp_prediction_1h"

# Fixed values, stated here again so that a wrong one in the library shows.
MEASURES = (
    "temperature",
    "feels_like",
    "humidity",
    "pressure",
    "pressure_msl",
    "dew_point",
    "wind_speed",
    "wind_direction",
    "wind_gusts",
    "wind_speed_80m",
    "wind_direction_80m",
    "cloud_cover",
    "precipitation",
    "rain",
    "snowfall",
    "visibility",
    "shortwave_radiation",
    "cape",
    "weather_code",
    "latitude",
    "longitude",
)
LAGGED = (
    "temperature",
    "humidity",
    "pressure",
    "wind_speed",
    "specific_humidity",
    "cape",
    "precipitation",
)
LAG_ROWS = (1, 2, 3, 6, 12)
ROLLED = (
    "temperature",
    "humidity",
    "pressure",
    "wind_speed",
    "specific_humidity",
    "shortwave_radiation",
)
ROLLING_HOURS = (6, 12, 24)
DIFFERENCES = {
    "temperature": "temp_change_1h",
    "pressure": "pressure_change_1h",
    "humidity": "humidity_change_1h",
}
CODE_TEXTS = {
    0: "clear sky",
    1: "mainly clear",
    2: "partly cloudy",
    3: "overcast",
    45: "fog",
    48: "depositing rime fog",
    51: "light drizzle",
    53: "moderate drizzle",
    55: "dense drizzle",
    61: "slight rain",
    63: "moderate rain",
    65: "heavy rain",
    71: "slight snow",
    73: "moderate snow",
    75: "heavy snow",
    77: "snow grains",
    80: "slight rain showers",
    81: "moderate rain showers",
    82: "violent rain showers",
    85: "slight snow showers",
    86: "heavy snow showers",
    95: "thunderstorm",
    96: "thunderstorm with slight hail",
    99: "thunderstorm with heavy hail",
}

OBS = f"""
with obs as (
  select concat('city_', user_id::varchar) as city, ts as {T}, event_id, event_type,
         {", ".join(f"({text})::double as {name}" for name, text in EVENT_MEASURES.items())}
  from (select *, json_extract_string(props, '$.k')::double as k from events)
),
vapour as (
  select *, humidity / 100.0::double * 6.112::double
            * exp(17.67::double * temperature / (temperature + 243.5::double)) as e
  from obs
),
base as (
  select * exclude (e),
         0.622::double * e / (pressure - 0.378::double * e) as specific_humidity,
         -wind_speed * sin(wind_direction * (pi() / 180)) as wind_u,
         -wind_speed * cos(wind_direction * (pi() / 180)) as wind_v
  from vapour
)"""

CALENDAR = f"""
  hour({T}) as hour, dayofweek({T}) + 1 as day_of_week, day({T}) as day_of_month,
  month({T}) as month, quarter({T}) as quarter"""

CYCLES = {
    "hour_sin": f"sin(hour({T}) * 2 * 3.14159::double / 24)",
    "hour_cos": f"cos(hour({T}) * 2 * 3.14159::double / 24)",
    "month_sin": f"sin(month({T}) * 2 * 3.14159::double / 12)",
    "month_cos": f"cos(month({T}) * 2 * 3.14159::double / 12)",
}


def num(expression: str, name: str | None = None, digits: int = 6) -> str:
    """A double rounded for comparison, in arithmetic every engine does alike."""
    scale = f"{10**digits}::double"
    return f"floor(({expression})::double * {scale} + 0.5::double) / {scale} as {name or expression}"


def nums(*names: str, digits: int = 6) -> str:
    return ", ".join(num(name, digits=digits) for name in names)


def feature(name: str, expression: str) -> str:
    return num(expression, name, 9 if name.startswith("specific_humidity") else 6)


def _over(hours: int | None = None) -> str:
    frame = f" range between interval {hours} hours preceding and current row" if hours else ""
    return f"over (partition by city order by {T}{frame})"


AGGREGATES = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "sum": "sum"}


def lags() -> dict[str, str]:
    return {
        f"{c}_lag_{k}h": f"lag({c}, {k}) {_over()}" for c in LAGGED for k in LAG_ROWS
    }


def rolling(*stats: str) -> dict[str, str]:
    return {
        f"{c}_{s}_{h}h": f"{AGGREGATES[s]}({c}) {_over(h)}"
        for h in ROLLING_HOURS
        for c in ROLLED
        for s in stats
    }


RAIN_SUM = {"precip_sum_6h": f"sum(precipitation) {_over(6)}"}
DELTAS = {name: f"{c} - lag({c}) {_over()}" for c, name in DIFFERENCES.items()}
TARGET = f"lead(temperature) {_over()}"
WILL_RAIN = f"case when lead(rain) {_over()} > 0 then 1 else 0 end"


def derived(columns: dict[str, str]) -> str:
    listed = ", ".join(feature(name, text) for name, text in columns.items())
    return f"{OBS} select city, {T}, {listed} from base"


def feature_frame() -> str:
    windows = {**lags(), **rolling("mean", "std", "min", "max"), **RAIN_SUM, **DELTAS}
    windows["target_temp_1h"] = TARGET
    plain = [*MEASURES, "specific_humidity", "wind_u", "wind_v"]
    listed = [feature(c, c) for c in plain]
    listed.append(CALENDAR.strip())
    listed += [num(text, name) for name, text in CYCLES.items()]
    listed += [feature(name, text) for name, text in windows.items()]
    listed += [f"({WILL_RAIN})::bigint as target_will_rain_1h"]
    return f"{OBS} select city, {T}, {', '.join(listed)} from base"


SNAPSHOT = "temperature, feels_like, humidity, pressure, wind_speed".split(", ")
_CODES = ", ".join(f"({code}, '{text}')" for code, text in CODE_TEXTS.items())
CODES = f"codes(code, txt) as (values {_CODES})"

SERVED = f"""{OBS}, {CODES}, snapshot as (
  select city, {T}, {nums(*SNAPSHOT)},
         coalesce(txt, concat('weather code ', weather_code::int)) as description
  from obs left join codes on codes.code = obs.weather_code::int
)"""

IN_RANGE = f"{T} between {AS_OF} - interval 168 hours and {AS_OF}"

DAILY = """
with daily as (
  select concat('city_', user_id::varchar) as city, date_trunc('day', ts)::timestamp as "timestamp",
         event_type, value, event_id
  from events
)"""

PERSISTENCE = f"""{OBS}, scored as (
  select city, {T}, temperature, {TARGET} as label, temperature as prediction,
         ({WILL_RAIN})::bigint as rain_label,
         (case when rain > 0 then 1 else 0 end)::bigint as rain_prediction
  from base
)"""

FORECASTS = f"""{OBS}, forecasts as (
  select city, {T} as source_timestamp, date_trunc('day', {T})::timestamp as prediction_timestamp,
         {num("temperature", "predicted_temperature", 4)},
         {num("case when rain > 0 then 1 else 0 end", "predicted_rain", 4)},
         {num("temperature", "observed_temperature", 4)},
         (case when event_type <> 'view' then 3 else 1 end)::bigint as horizon_hours,
         '{PREFIX}' as temp_model_name, strftime({T}, '%Y%m%d_%H%M%S') as temp_model_version,
         'unknown' as rain_model_name, 'unknown' as rain_model_version
  from obs
)"""

NEWEST = f"qualify row_number() over (partition by city order by {T} desc) = 1"


def score(predicted: str, name: str, version: str) -> str:
    return f"""
select city, {T} as source_timestamp, {SCORED_AT} as prediction_timestamp,
       {num(predicted, "predicted_temperature", 4)},
       null::double as predicted_rain, {num("temperature", "observed_temperature", 4)},
       1::bigint as horizon_hours, '{name}' as temp_model_name, '{version}' as temp_model_version,
       'unknown' as rain_model_name, 'unknown' as rain_model_version
from obs {NEWEST}"""


FLAGSHIP = f"""{OBS}, built as (
  select city, {T}, temperature, lag(temperature) {_over()} as temperature_lag_1h,
         avg(temperature) {_over(6)} as temperature_mean_6h,
         temperature - lag(temperature) {_over()} as temp_change_1h,
         sum(precipitation) {_over(6)} as precip_sum_6h
  from base
)
select city, {T}, {nums("temperature", "temperature_lag_1h", "temperature_mean_6h", "temp_change_1h", "precip_sum_6h")}
from built {NEWEST}"""

# Areas over the distinct scores, from high to low.
CURVE = """
with scored as (select value as score, (event_type = 'error')::int as hit from events),
steps as (
  select score, sum(hit)::double as p, sum(1 - hit)::double as n from scored group by score
),
curve as (
  select score, sum(p) over w as tp, sum(n) over w as fp, p, n from steps
  window w as (order by score desc rows between unbounded preceding and current row)
),
totals as (select sum(p) as tps, sum(n) as fps from steps)"""

ROC = f"""{CURVE}
select {num("sum(n * (tp - p / 2)) / (max(tps) * max(fps))", "auc_roc")}
from curve, totals"""

PR = f"""{CURVE},
points as (
  select tp / tps as recall, tp / (tp + fp) as prec, row_number() over (order by score desc) as i
  from curve, totals
),
pairs as (
  select recall, prec, coalesce(lag(recall) over (order by i), 0) as r0,
         coalesce(lag(prec) over (order by i), prec) as p0
  from points
)
select {num("sum((recall - r0) * (prec + p0) / 2)", "auc_pr")} from pairs"""


def sql() -> dict[str, str]:
    lookup = "coalesce(txt, concat('weather code ', weather_code::int))"
    return {
        "scan_obs": f"{OBS} select city, {T}, {nums(*MEASURES)} from obs",
        "scan_features": f"""{OBS} select city, {T}, {nums(*MEASURES)},
            hour({T}) as hour, month({T}) as month from obs""",
        "ingest_parse": f"""{OBS} select city, date_trunc('second', {T}) as {T},
            {nums(*MEASURES)}, 'ok' as time_status from obs""",
        "json_props": """select event_id, json_extract_string(props, '$.k')::bigint as k,
            true as ok from events""",
        "ingest_whitespace": f"""{OBS} select city, date_trunc('second', {T}) as {T},
            {num("temperature", "temp")} from obs where floor(epoch({T}))::bigint % 4 in (0, 3)""",
        "backfill_expand": """select case when user_id % 5 <> 0 then concat('city_', user_id::varchar)
            else 'unknown' end as city, date_trunc('second', ts)::timestamp as "timestamp", """
        + num("value / 10", "temp")
        + " from events",
        "json_encode": """select user_id::varchar as key, to_json({'event_id': event_id,
            'event_type': event_type, 'value': value})::varchar as value from events""",
        "upsert_last_wins": f"""{DAILY} select city, {T}, arg_max(value, event_id) as value,
            max(event_id) as event_id from daily group by all""",
        "insert_if_absent": f"""{DAILY}, stored as (
              select city, {T}, arg_max(value, event_id) as value, 'error' as event_type
              from daily where event_type = 'error' group by city, {T}
            ), offered as (
              select city, {T}, arg_min(value, event_id) as value,
                     arg_min(event_type, event_id) as event_type
              from daily group by city, {T}
            ), inserted as (
              select * from offered anti join stored using (city, {T})
            ), tally as (
              select (select count(*) from inserted) as inserted,
                     (select count(*) from daily) as offered
            )
            select city, {T}, value, event_type, inserted, offered - inserted as skipped
            from (select * from stored union all select * from inserted), tally""",
        "key_exists": """select c_custkey, c_name from customer
            semi join orders on o_custkey = c_custkey""",
        "explode_series": f"""select vec_id, (i * 3600)::bigint as time,
            {num("embedding[i + 1]", '"full"')},
            {num("case when i < 10 then embedding[i + 1] end", "short")},
            null::double as absent
            from (select *, unnest(range(len(embedding))) as i from embeddings)""",
        "flatten_obs": f"{OBS} select city, {T}, {nums(*MEASURES)} from obs",
        "snapshot_nest": f"""{OBS}, {CODES} select city, {T}, {num("temperature", "temp")},
            {num("pressure_msl", "sea_level")}, {num("wind_direction", "deg")},
            {num("cloud_cover", "clouds")}, weather_code::bigint as code,
            {lookup} as description, null::double as uv_index
            from obs left join codes on codes.code = obs.weather_code::int""",
        "coalesce_nested": f"""{OBS} select city,
            {num("case when event_type = 'view' then temperature + 100 else temperature end", "temperature")},
            {nums(*SNAPSHOT[1:])},
            case when event_type = 'error' then 'N/A' else event_type end as description, {T}
            from obs""",
        "composite_key": f"""{OBS} select concat(city, '_', floor(epoch({T}))::bigint) as id, {T}
            from obs""",
        "code_lookup": f"""{OBS}, {CODES} select event_id, weather_code::bigint as weather_code,
            {lookup} as description
            from obs left join codes on codes.code = obs.weather_code::int""",
        "specific_humidity": f"""{OBS} select city, {T}, {nums("specific_humidity", digits=9)}
            from base""",
        "wind_components": f"{OBS} select city, {T}, {nums('wind_u', 'wind_v')} from base",
        "time_features": f"{OBS} select city, {T}, {CALENDAR} from obs",
        "cyclic_features": derived(CYCLES),
        "unix_time": f"""select event_id,
            case event_type when 'view' then timestamp '1970-01-01'
                 when 'error' then {SCORED_AT} else date_trunc('second', ts) end as {T},
            case event_type when 'view' then 'missing' when 'error' then 'invalid'
                 else 'ok' end as time_status from events""",
        "version_tag": "select event_id, strftime(ts, '%Y%m%d_%H%M%S') as version from events",
        "hash_split": """select event_id, case when bucket < 6000 then 'train'
            when bucket < 8000 then 'validation' else 'test' end as part
            from (select event_id, concat('0x', substr(md5(concat('42|', event_id, '|', user_id)), 1, 8))::bigint
                         % 10000 as bucket from events)""",
        "lag_features": derived(lags()),
        "rolling_mean": derived(rolling("mean")),
        "rolling_std": derived(rolling("std")),
        "rolling_minmax": derived(rolling("min", "max")),
        "rolling_sum": derived(RAIN_SUM),
        "rolling_dense": derived({**rolling("mean", "std", "min", "max"), **RAIN_SUM}),
        "delta_features": derived(DELTAS),
        "lead_target": f"""{OBS} select city, {T}, {num(TARGET, "target_temp_1h")},
            ({WILL_RAIN})::bigint as target_will_rain_1h from base""",
        "feature_frame": feature_frame(),
        "incremental_features": feature_frame(),
        "refresh_equals_full": """select (select count(*) from events)
            + (select count(distinct ts) from events) as rows, 0::bigint as differing""",
        "resample_hour": f"""{OBS}, last as (
              select * from base
              qualify row_number() over (partition by city, date_trunc('hour', {T}) order by {T} desc) = 1
            ), lagged as (select *, lag(temperature) {_over()} as temperature_lag_1h from last)
            select city, {T}, {nums("temperature", "temperature_lag_1h")},
                   {num("temperature - temperature_lag_1h", "temp_change_1h")} from lagged""",
        "latest_features": FLAGSHIP,
        "dropna_essential": f"""{OBS} select * from (
            select city, {T}, {nums("temperature")}, {num(TARGET, "target_temp_1h")} from base)
            where target_temp_1h is not null""",
        "dropna_any": f"""{OBS} select * from (
            select city, {T}, {num(lags()["temperature_lag_12h"], "temperature_lag_12h")},
                   {num(rolling("std")["temperature_std_6h"], "temperature_std_6h")},
                   {num(TARGET, "target_temp_1h")} from base)
            where temperature_lag_12h is not null and temperature_std_6h is not null
              and target_temp_1h is not null""",
        "global_summary": f"""{OBS} select {num("avg(temperature)", "avg_temp")},
            {num("stddev_samp(temperature)", "std_temp")}, {num("avg(humidity)", "avg_humidity")},
            {num("avg(wind_speed)", "avg_wind_speed")},
            {num("avg(specific_humidity)", "avg_specific_humidity", 9)} from base""",
        "row_counts": f"""{PERSISTENCE} select count(*) as rows, count(label) as usable from scored""",
        "latest_join": f"""{DAILY}, newest as (
              select city, max({T}) as {T} from daily group by city
            ) select city, {T}, event_id, value from daily join newest using (city, {T})""",
        "latest_rownum": f"""{DAILY} select city, {T}, event_id, value from daily
            qualify row_number() over (partition by city order by {T} desc, event_id desc) = 1""",
        "city_filter": f"""{OBS} select city, {T}, {nums("temperature")} from obs
            where city = 'city_1'""",
        "current_one": f"""{SERVED} select * from snapshot where city = 'city_1'
            order by {T} desc limit 1""",
        "distinct_entities": f"{OBS} select distinct city from obs order by city",
        "latest_all": f"{SERVED} select * from snapshot {NEWEST}",
        "historical_range": f"""{SERVED} select * from snapshot where city = 'city_1'
            and {IN_RANGE} order by {T} desc limit 1000""",
        "period_stats": f"""{OBS} select city, {num("avg(temperature)", "avg_temperature")},
            {num("min(temperature)", "min_temperature")}, {num("max(temperature)", "max_temperature")},
            {num("avg(humidity)", "avg_humidity")}, {num("avg(pressure)", "avg_pressure")},
            count(*) as total_records, 168::bigint as period_hours,
            min({T}) as start_time, max({T}) as end_time
            from obs where {IN_RANGE} group by city""",
        "compare_entities": f"""{OBS} select city, {num("avg(temperature)", "avg_temperature")},
            {num("avg(humidity)", "avg_humidity")}, {num("avg(pressure)", "avg_pressure")},
            {num("avg(wind_speed)", "avg_wind_speed")}, count(*) as data_points,
            168::bigint as period_hours
            from obs where {IN_RANGE} and city in ('city_1', 'city_2', 'city_3', 'city_4')
            group by city order by avg_temperature desc, city""",
        "predictions_latest": f"""{FORECASTS} select * from forecasts
            qualify row_number() over (partition by city order by prediction_timestamp desc,
                                       source_timestamp desc) = 1 order by city""",
        "predictions_entity": f"""{FORECASTS} select * from forecasts where city = 'city_1'
            order by prediction_timestamp desc, source_timestamp desc limit 24""",
        "registry_latest": f"""select * from (
              select concat(case when event_type = 'purchase' then '{PREFIX}'
                                 else 'rain_prediction_1h' end, '_', user_id) as model_name,
                     concat('/models/', event_id) as path, ts as {T},
                     strftime(ts, '%Y%m%d_%H%M%S') as version from events)
            where starts_with(model_name, '{PREFIX}') order by {T} desc limit 1""",
        "abs_error": f"""{PERSISTENCE} select city, {T}, {nums("label", "prediction")},
            {num("abs(label - prediction)", "error")} from scored""",
        "regression_metrics": f"""{PERSISTENCE} select
            {num("sqrt(avg((label - prediction) ** 2))", "rmse")},
            {num("avg(abs(label - prediction))", "mae")},
            {num("1 - avg((label - prediction) ** 2) / var_pop(label)", "r2")}
            from scored where label is not null""",
        "confusion_matrix": f"""{PERSISTENCE} select rain_label, rain_prediction, count(*) as count
            from scored group by all""",
        "roc_auc": ROC,
        "pr_auc": PR,
        "train_regression": f"""{PERSISTENCE} select
            {num("regr_intercept(label, prediction)", "intercept", 4)},
            {num("regr_slope(label, prediction)", "slope", 4)}, count(label) as n
            from scored""",
        "train_classification": f"""{PERSISTENCE}
            select family, rain_label as label, rain_label as prediction, count(*) as count,
                   1.0::double as auc_roc, 1.0::double as auc_pr
            from scored, unnest(['GBTClassifier', 'RandomForestClassifier']) as families(family)
            where label is not null group by all""",
        "score_both": f"""{PERSISTENCE}, line as (
              select regr_intercept(label, prediction) as a, regr_slope(label, prediction) as b
              from scored
            )
            select city, {T} as source_timestamp, {SCORED_AT} as prediction_timestamp,
                   {num("(select a from line) + (select b from line) * temperature", "predicted_temperature", 4)},
                   (case when rain > 0 then 1 else 0 end)::double as predicted_rain,
                   {num("temperature", "observed_temperature", 4)}, 1::bigint as horizon_hours,
                   '{PREFIX}_LinearRegression' as temp_model_name, '1' as temp_model_version,
                   'rain_prediction_1h_RandomForest' as rain_model_name, '1' as rain_model_version
            from obs {NEWEST}""",
        "score_shape": f"{OBS} {score('null', 'unknown', 'unknown')}",
        "score_batch": f"""{PERSISTENCE}, line as (
              select regr_intercept(label, prediction) as a, regr_slope(label, prediction) as b
              from scored
            ) {score(
                "(select a from line) + (select b from line) * temperature",
                f"{PREFIX}_LinearRegression",
                "20240201_000000",
            )}""",
        "stream_upsert": f"""{OBS}, {CODES}, newest as (
              select city, date_trunc('day', {T})::timestamp as day,
                     arg_max(temperature, {T}) as temperature,
                     arg_max(weather_code, {T}) as weather_code
              from obs group by all
            )
            select concat(city, '_', floor(epoch(day))::bigint) as id, city, day as {T},
                   {num("temperature", "temp")}, {lookup} as description
            from newest left join codes on codes.code = newest.weather_code::int""",
    }
