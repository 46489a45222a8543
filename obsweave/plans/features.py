"""Feature derivation: the feature row is declared here and compiled to one select."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsweave.config import FeatureConfig
from obsweave.functions import columns as fn
from obsweave.operators import series
from obsweave.operators.keyed import SLOT
from obsweave.operators.latest import newest_row

# Which columns get which derived features.
LAGGED = (
    "temperature",
    "humidity",
    "pressure",
    "wind_speed",
    "specific_humidity",
    "cape",
    "precipitation",
)
ROLLED = (
    "temperature",
    "humidity",
    "pressure",
    "wind_speed",
    "specific_humidity",
    "shortwave_radiation",
)
ROLLING_STATS = ("mean", "std", "min", "max")
DELTAS = {
    "temperature": "temp_change_1h",
    "pressure": "pressure_change_1h",
    "humidity": "humidity_change_1h",
}
ESSENTIAL = ("temperature", "humidity", "pressure", "wind_speed")
KEYS = ("city", "timestamp")

AGGREGATES = {"mean": F.avg, "std": F.stddev, "min": F.min, "max": F.max, "sum": F.sum}


def target_columns(horizon: int = 1) -> tuple[str, str]:
    return f"target_temp_{horizon}h", f"target_will_rain_{horizon}h"


def with_physics(obs: DataFrame) -> DataFrame:
    """Specific humidity and wind components, where their inputs are present."""
    have, derived = set(obs.columns), {}
    if {"temperature", "humidity", "pressure"} <= have:
        derived["specific_humidity"] = fn.specific_humidity(
            F.col("temperature"), F.col("humidity"), F.col("pressure")
        )
    if {"wind_speed", "wind_direction"} <= have:
        derived["wind_u"], derived["wind_v"] = fn.wind_components(
            F.col("wind_speed"), F.col("wind_direction")
        )
    return obs.withColumns(derived) if derived else obs


def with_calendar(obs: DataFrame) -> DataFrame:
    time = F.col("timestamp")
    return obs.withColumns(fn.calendar_parts(time) | fn.cyclic_parts(time))


def lag_features(columns, config: FeatureConfig, window) -> list[Column]:
    return [
        F.lag(c, k).over(window).alias(f"{c}_lag_{k}h")
        for c in LAGGED
        if c in columns
        for k in config.lag_rows
    ]


def rolling_stats(columns, config: FeatureConfig) -> dict[int, dict[str, list[str]]]:
    """Frame length -> column -> statistics, the rain sum included."""
    wanted = {h: {c: list(ROLLING_STATS) for c in ROLLED if c in columns} for h in config.rolling_hours}
    if "precipitation" in columns:
        wanted.setdefault(config.rain_sum_hours, {})["precipitation"] = ["sum"]
    return {hours: stats for hours, stats in wanted.items() if stats}


def rolling_name(column: str, stat: str, hours: int) -> str:
    return f"precip_sum_{hours}h" if stat == "sum" else f"{column}_{stat}_{hours}h"


def rolling_features(columns, config: FeatureConfig, window) -> list[Column]:
    return [
        AGGREGATES[stat](c).over(series.hours_frame(window, hours)).alias(rolling_name(c, stat, hours))
        for hours, stats in rolling_stats(columns, config).items()
        for c, wanted in stats.items()
        for stat in wanted
    ]


def delta_features(columns, window) -> list[Column]:
    return [
        (F.col(c) - F.lag(c, 1).over(window)).alias(name)
        for c, name in DELTAS.items()
        if c in columns
    ]


def target_features(columns, config: FeatureConfig, window) -> list[Column]:
    temp, rain = target_columns(config.horizon)
    targets = []
    if "temperature" in columns:
        targets.append(F.lead("temperature", config.horizon).over(window).alias(temp))
    if "rain" in columns:
        wet = F.lead("rain", config.horizon).over(window) > 0
        targets.append(F.when(wet, 1).otherwise(0).alias(rain))
    return targets


GROUPS = ("lag", "rolling", "delta", "target")


def feature_order(columns, config: FeatureConfig, groups=GROUPS) -> list[str]:
    """The contract order of the derived window columns."""
    temp, rain = target_columns(config.horizon)
    names = {
        "lag": [f"{c}_lag_{k}h" for c in LAGGED if c in columns for k in config.lag_rows],
        "rolling": [
            rolling_name(c, stat, h)
            for h in config.rolling_hours
            for c in ROLLED
            if c in columns
            for stat in ROLLING_STATS
        ]
        + [rolling_name("precipitation", "sum", config.rain_sum_hours)]
        * ("precipitation" in columns),
        "delta": [name for c, name in DELTAS.items() if c in columns],
        "target": [temp] * ("temperature" in columns) + [rain] * ("rain" in columns),
    }
    return [name for group in GROUPS if group in groups for name in names[group]]


def windowed_features(
    base: DataFrame,
    config: FeatureConfig | None = None,
    *,
    groups=GROUPS,
    slots: int | None = None,
) -> DataFrame:
    """Lag, rolling, difference and target columns over a base with physics.

    Every window is taken in one pass: one exchange, one sort.  Split frames, all
    their lengths, are taken in the same tasks; ``config.frames``
    decides, never the data.  ``groups`` leaves out what is not needed, and with
    it the context it would need.  With ``slots`` a bucket's stations are dealt to
    that many tasks, and the column ``_slot`` says which, so that a write by days
    needs no other exchange.
    """
    config = config or FeatureConfig()
    columns = set(base.columns)
    frames = rolling_stats(columns, config) if "rolling" in groups else {}
    dense = config.frames == "split" and bool(frames)
    longest = max(frames, default=0)

    lagged = [c for c in LAGGED if "lag" in groups and c in columns]
    lagged += [c for c in DELTAS if "delta" in groups and c in columns]
    lags = [*(config.lag_rows if "lag" in groups else ()), *((1,) if "delta" in groups else ())]
    led = [c for c in ("temperature", "rain") if "target" in groups and c in columns]
    tagged = series.with_context(
        base,
        bucket_hours=-(-config.bucket_hours // longest) * longest if dense else config.bucket_hours,
        lookback_hours=longest,
        lag_rows=max(lags, default=0) if lagged else 0,
        lag_columns=lagged,
        lead_rows=config.horizon if led else 0,
        lead_columns=led,
        narrow=[*lagged, *(c for stats in frames.values() for c in stats)] if dense else None,
    )
    dealt = (SLOT,) if slots else ()
    if slots:
        tagged = tagged.withColumn(SLOT, F.pmod(F.xxhash64("city"), F.lit(slots))).repartition(series.BUCKET, SLOT)
    elif dense:
        tagged = tagged.repartition("city", series.BUCKET)
    window = series.series_window("city", *dealt)
    derived = lag_features(columns, config, window) if "lag" in groups else []
    derived += rolling_features(columns, config, window) if frames and not dense else []
    derived += delta_features(columns, window) if "delta" in groups else []
    derived += target_features(columns, config, window) if "target" in groups else []
    rows = tagged.select("*", *derived)
    rows = series.split_frames(rows, frames, name=rolling_name, dealt=dealt) if dense else series.own_rows(rows)
    return rows.select(*base.columns, *feature_order(columns, config, groups), *dealt)


def hourly(obs: DataFrame) -> DataFrame:
    """The last row of each city and hour, at its own time."""
    hour = obs.withColumn("_hour", F.date_trunc("hour", "timestamp"))
    return newest_row(hour, ["city", "_hour"], "timestamp").drop("_hour")


def build_features(obs: DataFrame, config: FeatureConfig | None = None, slots: int | None = None) -> DataFrame:
    """The full feature row of every observation, keyed by city and timestamp.

    Starts no job.  ``slots`` are those of ``windowed_features``.  Calendar columns are
    derived last, as they need no window and would widen its exchange.
    """
    config = config or FeatureConfig()
    base = with_physics(hourly(obs) if config.resample == "hour" else obs)
    rows = windowed_features(base, config, slots=slots)
    derived = rows.columns[len(base.columns) :]
    return with_calendar(rows).select(*with_calendar(base).columns, *derived)


def usable_rows(features: DataFrame) -> DataFrame:
    """Rows whose essential measures are known; the target may be still to come."""
    return features.dropna(subset=list(ESSENTIAL))


def complete_rows(features: DataFrame, horizon: int = 1) -> DataFrame:
    """Rows whose essential measures and temperature target are known."""
    wanted = [*ESSENTIAL, target_columns(horizon)[0]]
    return features.dropna(subset=wanted)


def summary(features: DataFrame) -> DataFrame:
    return features.agg(
        F.avg("temperature").alias("avg_temp"),
        F.stddev("temperature").alias("std_temp"),
        F.avg("humidity").alias("avg_humidity"),
        F.avg("wind_speed").alias("avg_wind_speed"),
        F.avg("specific_humidity").alias("avg_specific_humidity"),
    )
