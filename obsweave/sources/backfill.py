"""Historical payloads: column arrays per location to raw observation rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsweave.functions import columns as fn
from obsweave.operators.explode import explode_series
from obsweave.operators.keyed import (
    NewestTable,
    absent_rows,
    insert_if_absent,
    read_days,
    table_parts,
    with_day,
    with_part,
    write_days,
)
from obsweave.schemas import HOURLY_SERIES, PAYLOAD, READINGS, SEQUENCE
from obsweave.sources.messages import decoded, is_object

SOURCE = "historical_backfill"
LOCATION = ("city", "latitude", "longitude", "utc_offset_seconds", "timezone")


PAYLOAD_TEXT = T.StructType(
    [
        T.StructField("city", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("utc_offset_seconds", T.IntegerType()),
        T.StructField("timezone", T.StringType()),
        T.StructField(
            "hourly",
            T.StructType(
                [T.StructField("time", T.ArrayType(T.LongType()))]
                + [T.StructField(n, T.ArrayType(T.StringType())) for n in HOURLY_SERIES]
            ),
        ),
    ]
)


def parse_payloads(messages: DataFrame) -> DataFrame:
    """Payload text to typed columns: location fields, arrays, remaining fields as a map."""
    fields = F.from_json("value", "map<string,string>")
    return messages.select(
        F.from_json("value", PAYLOAD_TEXT).alias("_doc"),
        fn.map_without(fields, "hourly", "city").alias("hourly_meta"),
    ).select(
        *[f"_doc.{name}" for name in LOCATION],
        "hourly_meta",
        "_doc.hourly.*",
    )


def expand(payloads: DataFrame, now: Column | None = None) -> DataFrame:
    """One raw observation per hour, in the shape the live path writes."""
    now = F.current_timestamp() if now is None else now
    city = F.coalesce("city", F.lit("unknown"))
    points = explode_series(payloads, "time", HOURLY_SERIES, keep=(*LOCATION, "hourly_meta"))
    absent = F.lit(False)
    points = points.where(fn.time_status(F.col("time"), absent) == "ok")
    time = fn.seconds_to_time(F.col("time"), absent, now)
    readings = [
        (F.col(name).try_cast("double") if name in HOURLY_SERIES else F.lit(None)).alias(name)
        for name in READINGS
    ]
    payload = F.struct(*LOCATION, F.struct("time", *readings).alias("current")).cast(PAYLOAD)
    return points.select(
        fn.composite_key(city, time).alias("id"),
        city.alias("city"),
        time.alias("timestamp"),
        now.alias("fetched_at"),
        F.lit(SOURCE).alias("source"),
        F.lit("ok").alias("time_status"),
        payload.alias("payload"),
        "hourly_meta",
        F.lit(None).cast("string").alias("payload_json"),
        F.lit(None).cast(SEQUENCE).alias("sequence"),
    )


def unusable(messages: DataFrame, now: Column | None = None) -> DataFrame:
    """Dead letters: payload texts that are no object, lack their times, or hold unusable ones.

    A text with some usable hours gives those and is a dead letter as well.
    """
    times = F.col("_doc.hourly.time")
    spoilt = F.exists(times, lambda t: t.isNull() | (fn.time_status(t, F.lit(False)) != "ok"))
    reason = (
        F.when(~is_object(F.col("value"), F.lit(True)), "not a JSON object")
        .when(times.isNull(), "no usable time series")
        .when(spoilt, "unusable times")
    )
    return decoded(messages.select("value"), PAYLOAD_TEXT).select(
        "value",
        (F.current_timestamp() if now is None else now).alias("received_at"),
        reason.alias("reason"),
        F.lit(None).cast(SEQUENCE).alias("sequence"),
    ).where("reason is not null")


def backfill(
    messages: DataFrame, raw_path: str, dead_letter_path: str | None = None, newest: Sequence[NewestTable] = ()
) -> tuple[int, int]:
    """Insert the hours the raw table does not hold yet; returns (inserted, skipped).

    Texts that lose anything go to the dead-letter table, where one is named;
    ``newest`` names tables of newest raw rows to keep up.
    """
    if dead_letter_path:
        keep_letters(unusable(messages), dead_letter_path)
    return insert_if_absent(expand(parse_payloads(messages)), raw_path, newest=newest)


def keep_letters(letters: DataFrame, path: str) -> None:
    """Append the texts that the dead-letter table does not hold yet, whenever they came."""
    held, parts = read_days(letters.sparkSession, path), table_parts(letters.sparkSession, path)
    fresh = letters.dropDuplicates(["value"])
    if held is not None:
        fresh = absent_rows(held, fresh, ["value", "reason"])
    write_days(with_part(with_day(fresh, "received_at"), "value", parts), path, "append", sort=())
