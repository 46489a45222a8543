"""Read queries over the snapshot and prediction tables, as DataFrames.

Time ranges are closed: from ``hours`` before ``as_of`` up to ``as_of`` (now by
default).  Unknown stations give empty results.  Reads of newest rows take any
table, and the ``*_now`` ones the table of newest rows, which spares the history.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsweave.functions.columns import instant
from obsweave.operators.keyed import NewestTable
from obsweave.operators.latest import newest_row, on_newest_days
from obsweave.plans.scoring import PREDICTION_TIES
from obsweave.schemas import CURRENT_OBS, PREDICTIONS
from obsweave.sources.tables import on_days

MAX_HOURS, MAX_HISTORY, MAX_PREDICTIONS = 168, 1000, 500

# Flat name -> path in the nested snapshot.
SNAPSHOT_PATHS = {
    "temperature": "data.main.temp",
    "feels_like": "data.main.feels_like",
    "humidity": "data.main.humidity",
    "pressure": "data.main.pressure",
    "wind_speed": "data.wind.speed",
}


def _check(name: str, value: int, most: int) -> int:
    if not 1 <= value <= most:
        raise ValueError(f"{name} must be between 1 and {most}")
    return value


def _in_range(obs: DataFrame, hours: int, as_of: Column | datetime | None) -> DataFrame:
    _check("hours", hours, MAX_HOURS)
    end = F.current_timestamp() if as_of is None else instant(as_of)
    start = end - F.make_dt_interval(hours=F.lit(hours))
    return on_days(obs, start, end).where(F.col("timestamp").between(start, end))


def readings(obs: DataFrame) -> DataFrame:
    """The served columns: a top-level value where the table has one, else the nested one."""
    nested = "data" in obs.columns

    def value(name: str) -> Column:
        found = [F.col(name)] if name in obs.columns else []
        found += [F.col(SNAPSHOT_PATHS[name])] if nested else []
        return F.coalesce(*found).alias(name) if found else F.lit(None).cast("double").alias(name)

    texts = [F.col("description")] if "description" in obs.columns else []
    texts += [F.get(F.col("data.weather.description"), F.lit(0))] if nested else []
    return obs.select(
        "city",
        *[value(name) for name in SNAPSHOT_PATHS],
        F.coalesce(*texts, F.lit("N/A")).alias("description"),
        "timestamp",
    )


def of_city(rows: DataFrame, city: str) -> DataFrame:
    """The rows of one station."""
    return rows.where(F.col("city") == city)


def current(obs: DataFrame, city: str) -> DataFrame:
    """The newest observation of one station."""
    newest = on_newest_days(of_city(obs, city)).orderBy(F.col("timestamp").desc()).limit(1)
    return readings(newest)


def cities(obs: DataFrame) -> DataFrame:
    return obs.select("city").distinct().orderBy("city")


def current_all(obs: DataFrame) -> DataFrame:
    """The newest observation of every station."""
    return newest_row(readings(on_newest_days(obs)))


def current_now(newest: NewestTable, spark: SparkSession, city: str) -> DataFrame:
    """``current`` from the kept newest rows: one part of one small table."""
    return readings(newest.of(spark, city, CURRENT_OBS))


def cities_now(newest: NewestTable, spark: SparkSession) -> DataFrame:
    return newest.read(spark, CURRENT_OBS).select("city").orderBy("city")


def current_all_now(newest: NewestTable, spark: SparkSession) -> DataFrame:
    return readings(newest.read(spark, CURRENT_OBS))


def history(
    obs: DataFrame, city: str, hours: int = 24, limit: int = 100, as_of=None
) -> DataFrame:
    """The newest ``limit`` observations of a station in the range, newest first."""
    _check("limit", limit, MAX_HISTORY)
    found = _in_range(obs, hours, as_of).where(F.col("city") == city)
    return readings(found.orderBy(F.col("timestamp").desc()).limit(limit))


def _rounded(value: Column, digits: int | None) -> Column:
    return value if digits is None else F.round(value, digits)


def _flat(obs: DataFrame) -> DataFrame:
    return readings(obs).drop("description", "feels_like")


def statistics(
    obs: DataFrame, city: str | None = None, hours: int = 24, as_of=None, digits: int | None = 2
) -> DataFrame:
    """Period statistics of one station, or of all of them in one job."""
    found = _in_range(obs, hours, as_of)
    if city is not None:
        found = found.where(F.col("city") == city)
    measured = _flat(found).groupBy("city").agg(
        _rounded(F.avg("temperature"), digits).alias("avg_temperature"),
        _rounded(F.min("temperature"), digits).alias("min_temperature"),
        _rounded(F.max("temperature"), digits).alias("max_temperature"),
        _rounded(F.avg("humidity"), digits).alias("avg_humidity"),
        _rounded(F.avg("pressure"), digits).alias("avg_pressure"),
        F.count(F.lit(1)).alias("total_records"),
        F.min("timestamp").alias("start_time"),
        F.max("timestamp").alias("end_time"),
    )
    return measured.withColumn("period_hours", F.lit(hours))


def city_list(names: str | Sequence[str]) -> list[str]:
    """Station names from a list or a comma-separated text; at least two."""
    parts = names.split(",") if isinstance(names, str) else names
    wanted = [name.strip() for name in parts]
    if len(wanted) < 2:
        raise ValueError("at least 2 cities are needed for a comparison")
    return list(dict.fromkeys(wanted))


def compare(
    obs: DataFrame, names: str | Sequence[str], hours: int = 24, as_of=None, digits: int | None = 2
) -> DataFrame:
    """Averages of the named stations in one job, warmest first; absent ones left out."""
    wanted = city_list(names)
    found = _flat(_in_range(obs, hours, as_of).where(F.col("city").isin(wanted)))
    averages = [
        _rounded(F.avg(c), digits).alias(f"avg_{c}")
        for c in ("temperature", "humidity", "pressure", "wind_speed")
    ]
    compared = found.groupBy("city").agg(*averages, F.count(F.lit(1)).alias("data_points"))
    return compared.withColumn("period_hours", F.lit(hours)).orderBy(
        F.col("avg_temperature").desc(), "city"
    )


def prediction_rows(predictions: DataFrame) -> DataFrame:
    """The served prediction columns, with a horizon of 1 hour where none is stored."""
    return predictions.select(
        "city",
        "source_timestamp",
        "prediction_timestamp",
        "predicted_temperature",
        "predicted_rain",
        "observed_temperature",
        F.coalesce("horizon_hours", F.lit(1)).alias("horizon_hours"),
        "temp_model_name",
        "temp_model_version",
        "rain_model_name",
        "rain_model_version",
    )


def latest_predictions(predictions: DataFrame) -> DataFrame:
    """The newest prediction of every station, by station name."""
    newest = newest_row(
        predictions,
        time="prediction_timestamp",
        tie_break=[F.col(c).desc_nulls_last() for c in PREDICTION_TIES],
    )
    return prediction_rows(newest).orderBy("city")


def city_predictions(predictions: DataFrame, city: str, limit: int = 24) -> DataFrame:
    """The newest predictions of one station, newest first."""
    _check("limit", limit, MAX_PREDICTIONS)
    order = [F.col(c).desc_nulls_last() for c in ("prediction_timestamp", *PREDICTION_TIES)]
    found = predictions.where(F.col("city") == city).orderBy(*order).limit(limit)
    return prediction_rows(found)


def latest_predictions_now(newest: NewestTable, spark: SparkSession) -> DataFrame:
    """``latest_predictions`` from the kept newest rows."""
    return latest_predictions(newest.read(spark, PREDICTIONS))


def city_predictions_now(newest: NewestTable, spark: SparkSession, city: str, limit: int = 24) -> DataFrame:
    """``city_predictions`` from the kept newest rows of the station; ``limit`` is at most what the table keeps."""
    _check("limit", limit, newest.keep)
    return city_predictions(newest.of(spark, city, PREDICTIONS), city, limit)
