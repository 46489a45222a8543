"""Observation view over the provided event table: the series the queries run on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Measures derived from an event; k is the number in its JSON properties.  Both
# engines read this text, so it is plain SQL.
EVENT_MEASURES = {
    "temperature": "value / 10",
    "feels_like": "value / 10 - 1",
    "humidity": "k",
    "pressure": "950 + k",
    "pressure_msl": "955 + k",
    "dew_point": "value / 20",
    "wind_speed": "value / 25",
    "wind_direction": "k * 3.6",
    "wind_gusts": "value / 20",
    "wind_speed_80m": "value / 16",
    "wind_direction_80m": "k * 1.8",
    "cloud_cover": "k",
    "precipitation": "case when event_type = 'error' then value / 100 else 0 end",
    "rain": "case when event_type = 'error' then value / 100 else 0 end",
    "snowfall": "case when event_type = 'view' then value / 50 else 0 end",
    "visibility": "k * 100",
    "shortwave_radiation": "value * 2",
    "cape": "k * 5",
    "weather_code": "k",
    "latitude": "user_id / 16",
    "longitude": "user_id / 8",
}


def double(expression: str) -> Column:
    return F.expr(f"cast({expression} as double)")


def observations(spark: SparkSession, sf_dir: str, *extra: str, spread: bool = False) -> DataFrame:
    """Flat observations (city, timestamp, 21 measures) plus ``extra`` event columns.

    ``spread`` deals the events out before anything is derived: one task reads a
    row group, however large.
    """
    events = table(spark, sf_dir, "events")
    events = events.repartition("event_id") if spread else events
    events = events.withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    return events.select(
        F.concat(F.lit("city_"), F.col("user_id").cast("string")).alias("city"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        *[double(text).alias(name) for name, text in EVENT_MEASURES.items()],
        *extra,
    )
