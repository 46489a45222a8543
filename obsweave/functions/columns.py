"""Column expressions: physics, calendar, keys, time parsing, code texts."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# The short pi the cyclic encodings are defined with.
CYCLE_PI = 3.14159

# Observation code texts.
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

# Seconds a calendar year 1..9999 can hold; anything outside is not a time.
FIRST_SECOND, LAST_SECOND = -62135596800, 253402300799


def specific_humidity(temperature: Column, humidity: Column, pressure: Column) -> Column:
    """Specific humidity in kg/kg from degrees C, percent and hPa; null where undefined."""
    # The constants of the saturation formula and of the gas ratio.
    saturation = 6.112 * F.exp(F.try_divide(17.67 * temperature, temperature + 243.5))
    vapour = humidity / 100.0 * saturation
    return F.try_divide(0.622 * vapour, pressure - 0.378 * vapour).cast("double")


def wind_components(speed: Column, direction: Column) -> tuple[Column, Column]:
    """Eastward and northward wind from speed and the bearing it blows from."""
    bearing = direction * (math.pi / 180.0)
    return (-speed * F.sin(bearing)).cast("double"), (-speed * F.cos(bearing)).cast("double")


def calendar_parts(time: Column) -> dict[str, Column]:
    return {
        "hour": F.hour(time),
        "day_of_week": F.dayofweek(time),
        "day_of_month": F.dayofmonth(time),
        "month": F.month(time),
        "quarter": F.quarter(time),
    }


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    angle = value * 2 * CYCLE_PI / period
    return F.sin(angle), F.cos(angle)


def cyclic_parts(time: Column) -> dict[str, Column]:
    hour_sin, hour_cos = cyclic(F.hour(time), 24)
    month_sin, month_cos = cyclic(F.month(time), 12)
    return {
        "hour_sin": hour_sin,
        "hour_cos": hour_cos,
        "month_sin": month_sin,
        "month_cos": month_cos,
    }


def composite_key(city: Column, time: Column) -> Column:
    return F.concat_ws("_", city, F.unix_timestamp(time))


def version_tag(time: Column) -> Column:
    return F.date_format(time, "yyyyMMdd_HHmmss")


def code_text(code: Column) -> Column:
    """Text of an observation code; the code itself where it has none."""
    texts = F.create_map(*[F.lit(x) for pair in CODE_TEXTS.items() for x in pair])
    number = code.cast("int")
    return F.coalesce(
        F.try_element_at(texts, number),
        F.concat(F.lit("weather code "), F.coalesce(number.cast("string"), F.lit("None"))),
    )


def instant(value: Column | datetime) -> Column:
    """A time as a column; a datetime without zone is in the session's zone."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp")


def seconds_to_time(seconds: Column, missing: Column, now: Column) -> Column:
    """Unix seconds to a time: absent means the epoch, unusable means now."""
    usable = seconds.between(FIRST_SECOND, LAST_SECOND)
    return (
        F.when(missing, F.timestamp_seconds(F.lit(0)))
        .when(usable, F.timestamp_seconds(F.when(usable, seconds)))
        .otherwise(now)
    )


def time_status(seconds: Column, missing: Column) -> Column:
    return (
        F.when(missing, "missing")
        .when(seconds.between(FIRST_SECOND, LAST_SECOND), "ok")
        .otherwise("invalid")
    )


def hash_bucket(*parts: Column, buckets: int = 100) -> Column:
    """A bucket in [0, buckets) that depends on the key alone, never on partitioning."""
    digest = F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8)
    return F.conv(digest, 16, 10).cast("bigint") % buckets


def map_without(entries: Column, *names: str) -> Column:
    return F.map_filter(entries, lambda name, _: ~name.isin(*names))
