"""Live ingest: message stream to the raw table, the snapshot table and dead letters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from obsweave.functions import columns as fn
from obsweave.operators.keyed import NewestTable, compact, touched, upsert, with_day
from obsweave.schemas import CURRENT_OBS, RAW_OBS
from obsweave.sources.messages import parse, sequence


@dataclass(frozen=True)
class Tables:
    raw: str
    current: str
    dead_letter: str
    newest: str | None = None  # one snapshot a station, for the reads of current values

    @classmethod
    def under(cls, base: str) -> Tables:
        base = base.rstrip("/")
        return cls(f"{base}/raw_obs", f"{base}/current_obs", f"{base}/dead_letter", f"{base}/newest_obs")

    @property
    def newest_table(self) -> NewestTable | None:
        return NewestTable(self.newest, order="sequence") if self.newest else None


def raw_rows(parsed: DataFrame, now: Column | None = None) -> DataFrame:
    now = F.current_timestamp() if now is None else now
    return parsed.select(
        fn.composite_key(F.col("city"), F.col("timestamp")).alias("id"),
        "city",
        "timestamp",
        now.alias("fetched_at"),
        F.lit("live").alias("source"),
        "time_status",
        "payload",
        F.lit(None).cast(RAW_OBS["hourly_meta"].dataType).alias("hourly_meta"),
        "payload_json",
        "sequence",
    )


def snapshot_data(current: str = "payload.current", code_absent: Column | None = None) -> Column:
    """The nested snapshot of one observation; an absent code reads as code 0."""

    def at(name: str) -> Column:
        return F.col(f"{current}.{name}")

    def group(**names: str) -> Column:
        return F.struct(*[at(source).alias(name) for name, source in names.items()])

    code = at("weather_code").cast("int")
    described = F.coalesce(code, F.lit(0)) if code_absent is None else F.when(
        code_absent, F.lit(0)
    ).otherwise(code)
    return F.struct(
        group(
            temp="temperature_2m",
            feels_like="apparent_temperature",
            humidity="relative_humidity_2m",
            pressure="surface_pressure",
            sea_level="pressure_msl",
            dew_point="dew_point_2m",
        ).alias("main"),
        group(
            speed="wind_speed_10m", deg="wind_direction_10m", gust="wind_gusts_10m"
        ).alias("wind"),
        group(all="cloud_cover").alias("clouds"),
        F.array(
            F.struct(code.alias("id"), fn.code_text(described).alias("description"))
        ).alias("weather"),
        at("precipitation"),
        at("rain"),
        at("showers"),
        at("snowfall"),
        at("visibility"),
        at("shortwave_radiation"),
        at("uv_index"),
        at("is_day").cast("int"),
    ).cast(CURRENT_OBS["data"].dataType)


def snapshot_rows(parsed: DataFrame, now: Column | None = None) -> DataFrame:
    now = F.current_timestamp() if now is None else now
    return parsed.select(
        fn.composite_key(F.col("city"), F.col("timestamp")).alias("id"),
        "city",
        "timestamp",
        now.alias("processed_at"),
        snapshot_data(code_absent=F.col("code_absent")).alias("data"),
        F.col("payload.latitude").alias("latitude"),
        F.col("payload.longitude").alias("longitude"),
        F.col("payload.utc_offset_seconds").alias("utc_offset_seconds"),
        F.col("payload.timezone").alias("timezone"),
        "sequence",
    )


def store_batch(messages: DataFrame, tables: Tables, now: Column | None = None) -> None:
    """Write one batch to its tables.  Replaying a batch leaves the same rows.

    ``sequence`` orders the writes and is stored, so a late batch does not
    replace newer rows; a plain number counts within ``received_at``.
    """
    if not isinstance(messages.schema["sequence"].dataType, StructType):
        messages = messages.withColumn("sequence", sequence(F.col("received_at"), offset=F.col("sequence")))
    extra = ["received_at", "sequence"]
    parsed = parse(messages, now=F.col("received_at") if now is None else now, extra=extra)
    parsed = parsed.persist()
    try:
        good = parsed.where("valid")
        if not good.isEmpty():
            upsert(raw_rows(good, now), tables.raw, order="sequence")
            followers = [tables.newest_table] if tables.newest else []
            upsert(snapshot_rows(good, now), tables.current, order="sequence", newest=followers)
        bad = parsed.where(~F.col("valid"))
        if not bad.isEmpty():
            letters = bad.select(
                F.col("payload_json").alias("value"),
                "received_at",
                F.lit("not a JSON object").alias("reason"),
                "sequence",
            )
            keep_letters(letters, tables.dead_letter)
    finally:
        parsed.unpersist()


def keep_letters(letters: DataFrame, path: str) -> None:
    """Keyed write of dead letters, so that a replayed batch adds none."""
    upsert(letters, path, keys=("received_at", "sequence", "value"), time="received_at", part_by="value")


def compact_days(messages: DataFrame, tables: Tables) -> None:
    """Merge the files of the days that a batch has written to."""
    parsed = parse(messages, now=F.col("received_at"))
    days = [d for (d,) in touched(with_day(parsed.where("valid")))]
    for path in (tables.raw, tables.current):
        compact(messages.sparkSession, path, days)


def start_ingest(
    messages: DataFrame, tables: Tables, checkpoint: str, compact_every: int = 30, **trigger
) -> StreamingQuery:
    """Run the ingest over a message stream with value, received_at and sequence.

    After every ``compact_every`` batches the days just written are compacted
    (0: never).

    The checkpoint commits a batch after all its writes, so a batch may be
    written again after a failure; keyed replacement makes that harmless.
    """

    def store(batch: DataFrame, number: int) -> None:
        store_batch(batch, tables)
        if compact_every and number % compact_every == compact_every - 1:
            compact_days(batch, tables)

    return (
        messages.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "2 minutes"}))
        .start()
    )
