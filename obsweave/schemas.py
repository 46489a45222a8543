"""Declared schemas of every table the jobs read or write."""

from __future__ import annotations

from pyspark.sql import types as T

DOUBLE, LONG, STRING, TIMESTAMP, INT = (
    T.DoubleType(),
    T.LongType(),
    T.StringType(),
    T.TimestampType(),
    T.IntegerType(),
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# Flat measure name -> path below the payload.
MEASURE_PATHS: dict[str, str] = {
    "temperature": "current.temperature_2m",
    "feels_like": "current.apparent_temperature",
    "humidity": "current.relative_humidity_2m",
    "pressure": "current.surface_pressure",
    "pressure_msl": "current.pressure_msl",
    "dew_point": "current.dew_point_2m",
    "wind_speed": "current.wind_speed_10m",
    "wind_direction": "current.wind_direction_10m",
    "wind_gusts": "current.wind_gusts_10m",
    "wind_speed_80m": "current.wind_speed_80m",
    "wind_direction_80m": "current.wind_direction_80m",
    "cloud_cover": "current.cloud_cover",
    "precipitation": "current.precipitation",
    "rain": "current.rain",
    "snowfall": "current.snowfall",
    "visibility": "current.visibility",
    "shortwave_radiation": "current.shortwave_radiation",
    "cape": "current.cape",
    "weather_code": "current.weather_code",
    "latitude": "latitude",
    "longitude": "longitude",
}
MEASURES = tuple(MEASURE_PATHS)

# Numeric readings of one observation as the messages name them.
READINGS = (
    "temperature_2m",
    "apparent_temperature",
    "relative_humidity_2m",
    "surface_pressure",
    "pressure_msl",
    "dew_point_2m",
    "wind_speed_10m",
    "wind_direction_10m",
    "wind_gusts_10m",
    "wind_speed_80m",
    "wind_direction_80m",
    "cloud_cover",
    "precipitation",
    "rain",
    "showers",
    "snowfall",
    "visibility",
    "shortwave_radiation",
    "cape",
    "weather_code",
    "uv_index",
    "is_day",
)

# Hourly series a payload may carry next to its time array.
HOURLY_SERIES = (
    "temperature_2m",
    "relative_humidity_2m",
    "dew_point_2m",
    "precipitation",
    "rain",
    "snowfall",
    "weather_code",
    "pressure_msl",
    "surface_pressure",
    "cloud_cover",
    "visibility",
    "wind_speed_10m",
    "wind_direction_10m",
    "wind_gusts_10m",
    "shortwave_radiation",
    "cape",
    "wind_speed_80m",
    "wind_direction_80m",
    "apparent_temperature",
)

CURRENT = T.StructType(
    [T.StructField("time", LONG)] + [T.StructField(name, DOUBLE) for name in READINGS]
)

PAYLOAD = T.StructType(
    [
        T.StructField("city", STRING),
        T.StructField("latitude", DOUBLE),
        T.StructField("longitude", DOUBLE),
        T.StructField("utc_offset_seconds", INT),
        T.StructField("timezone", STRING),
        T.StructField("current", CURRENT),
    ]
)

# The order of writes to a key.
SEQUENCE = T.StructType(
    [T.StructField("at", TIMESTAMP), T.StructField("partition", INT), T.StructField("offset", T.LongType())]
)

RAW_OBS = T.StructType(
    [
        T.StructField("id", STRING),
        T.StructField("city", STRING),
        T.StructField("timestamp", TIMESTAMP),
        T.StructField("fetched_at", TIMESTAMP),
        T.StructField("source", STRING),
        T.StructField("time_status", STRING),
        T.StructField("payload", PAYLOAD),
        T.StructField("hourly_meta", T.MapType(STRING, STRING)),
        T.StructField("payload_json", STRING),
        T.StructField("sequence", SEQUENCE),
    ]
)

SNAPSHOT_DATA = T.StructType(
    [
        T.StructField(
            "main",
            _struct(
                temp=DOUBLE,
                feels_like=DOUBLE,
                humidity=DOUBLE,
                pressure=DOUBLE,
                sea_level=DOUBLE,
                dew_point=DOUBLE,
            ),
        ),
        T.StructField("wind", _struct(speed=DOUBLE, deg=DOUBLE, gust=DOUBLE)),
        T.StructField("clouds", _struct(all=DOUBLE)),
        T.StructField("weather", T.ArrayType(_struct(id=INT, description=STRING))),
        T.StructField("precipitation", DOUBLE),
        T.StructField("rain", DOUBLE),
        T.StructField("showers", DOUBLE),
        T.StructField("snowfall", DOUBLE),
        T.StructField("visibility", DOUBLE),
        T.StructField("shortwave_radiation", DOUBLE),
        T.StructField("uv_index", DOUBLE),
        T.StructField("is_day", INT),
    ]
)

CURRENT_OBS = T.StructType(
    [
        T.StructField("id", STRING),
        T.StructField("city", STRING),
        T.StructField("timestamp", TIMESTAMP),
        T.StructField("processed_at", TIMESTAMP),
        T.StructField("data", SNAPSHOT_DATA),
        T.StructField("latitude", DOUBLE),
        T.StructField("longitude", DOUBLE),
        T.StructField("utc_offset_seconds", INT),
        T.StructField("timezone", STRING),
        T.StructField("sequence", SEQUENCE),
    ]
)

FLAT_OBS = T.StructType(
    [T.StructField("city", STRING), T.StructField("timestamp", TIMESTAMP)]
    + [T.StructField(name, DOUBLE) for name in MEASURES]
)

MODEL_REGISTRY = _struct(
    model_name=STRING, model_type=STRING, path=STRING, timestamp=TIMESTAMP, version=STRING
)

TRAINING_RUNS = T.StructType(
    [
        T.StructField("run_name", STRING),
        T.StructField("model_type", STRING),
        T.StructField("model_name", STRING),
        T.StructField("horizon_hours", INT),
        T.StructField("logged_at", TIMESTAMP),
        T.StructField("params", T.MapType(STRING, STRING)),
        T.StructField("metrics", T.MapType(STRING, DOUBLE)),
        T.StructField("importances", T.ArrayType(_struct(feature=STRING, weight=DOUBLE))),
        T.StructField("model_path", STRING),
    ]
)

PREDICTIONS = _struct(
    city=STRING,
    source_timestamp=TIMESTAMP,
    prediction_timestamp=TIMESTAMP,
    predicted_temperature=DOUBLE,
    predicted_rain=DOUBLE,
    observed_temperature=DOUBLE,
    horizon_hours=INT,
    temp_model_name=STRING,
    temp_model_version=STRING,
    rain_model_name=STRING,
    rain_model_version=STRING,
)

DEAD_LETTER = _struct(value=STRING, received_at=TIMESTAMP, reason=STRING, sequence=SEQUENCE)
