"""Messages in and out: topic or file streams, JSON decode, JSON encode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsweave.functions import columns as fn
from obsweave.schemas import HOURLY_SERIES, READINGS, SEQUENCE

def stream_topic(spark: SparkSession, servers: str, topic: str, **options) -> DataFrame:
    """Message text from a topic, from its start; the checkpoint keeps the position.

    Offsets of different topic partitions do not compare, so messages are ordered
    by the topic's time first.  The first batch is all the topic holds unless
    ``maxOffsetsPerTrigger`` bounds it.
    """
    settings = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
    } | options
    messages = spark.readStream.format("kafka").options(**settings).load()
    return messages.select(
        F.col("value").cast("string").alias("value"),
        F.col("timestamp").alias("received_at"),
        sequence(F.col("timestamp"), F.col("partition"), F.col("offset")),
    )


def sequence(at: Column, partition: Column | None = None, offset: Column | None = None) -> Column:
    """The order of writes: by time, then by place in the topic."""
    parts = (at, F.lit(0) if partition is None else partition, F.lit(0) if offset is None else offset)
    return F.struct(*parts).cast(SEQUENCE).alias("sequence")


def stream_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """Message text from JSON-lines files, for tests and replays.

    ``sequence`` is the arrival time of the file: of two messages with one key,
    the one in the later file is the later write.
    """
    lines = spark.readStream.format("text").options(**options).load(path)
    arrived = F.col("_metadata.file_modification_time")
    return lines.select(
        "value",
        arrived.alias("received_at"),
        sequence(arrived),
    )


def encode(df: DataFrame, key: str = "city", columns: Sequence[str] | None = None) -> DataFrame:
    """Rows as messages: the key and a JSON value, ready for a topic."""
    fields = columns or df.columns
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*fields)).alias("value"))


def publish(messages: DataFrame, format: str = "kafka", path: str | None = None, **options) -> None:
    """Write encoded messages to a topic (option ``topic``), or to files with another ``format``."""
    writer = messages.write.format(format).options(**options).mode("append")
    writer.save(path) if path else writer.save()


# The time and the code are decoded as variants, which tell absent from null.
MESSAGE = T.StructType(
    [
        T.StructField("city", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("utc_offset_seconds", T.IntegerType()),
        T.StructField("timezone", T.StringType()),
        T.StructField(
            "current",
            T.StructType(
                [T.StructField("time", T.VariantType())]
                + [
                    T.StructField(n, T.VariantType() if n == "weather_code" else T.DoubleType())
                    for n in READINGS
                ]
            ),
        ),
        T.StructField(
            "hourly",
            T.StructType(
                [T.StructField("time", T.ArrayType(T.LongType()))]
                + [T.StructField(n, T.ArrayType(T.StringType())) for n in HOURLY_SERIES]
            ),
        ),
        T.StructField("_bad", T.StringType()),
    ]
)


JSON_WHITE = " \t\r\n"


def decoded(messages: DataFrame, schema, column: str = "value", name: str = "_doc") -> DataFrame:
    """``messages`` with the text of ``column`` decoded once, in column ``name``.

    The decoder stands in a generator, so that filters on what it gives do not
    bring it in a second time.
    """
    options = {"columnNameOfCorruptRecord": "_bad"}
    return messages.select("*", F.explode(F.array(F.from_json(column, schema, options))).alias(name))


def is_object(text: Column, flagged: Column) -> Column:
    """Whether a text is one JSON object; only ``flagged`` texts are looked at again."""
    stripped = F.btrim(text, F.lit(JSON_WHITE))
    braced = stripped.startswith("{") & stripped.endswith("}")
    return F.coalesce(braced & (~flagged | F.json_object_keys(text).isNotNull()), F.lit(False))


def whole_seconds(value: Column) -> Column:
    """Unix seconds of a variant: numbers are cut to whole, texts must be whole numbers."""
    text = F.try_variant_get(value, "$", "string").try_cast("bigint")
    number = F.try_variant_get(value, "$", "double").try_cast("bigint")
    return F.when(F.schema_of_variant(value) == "STRING", text).otherwise(number)


def parse(messages: DataFrame, now: Column | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """Message text to typed columns; ``valid`` is false where it is no JSON object.

    Each message is decoded once.  A field of the wrong type is null by itself
    and does not spoil its message.  Readings a message lacks are taken from
    its hourly series at the hour of its time.
    """
    now = F.current_timestamp() if now is None else now
    time = F.col("_doc.current.time")
    dated = decoded(messages, MESSAGE).withColumns({"_seconds": whole_seconds(time), "_missing": time.isNull()})
    hour = F.col("_seconds") - F.pmod(F.col("_seconds"), F.lit(3600).cast("bigint"))
    position = F.array_position("_doc.hourly.time", hour)
    timed = dated.withColumn("_at", F.when(position > 0, position.cast("int")))

    def reading(name: str) -> Column:
        current = F.col(f"_doc.current.{name}")
        if name == "weather_code":
            current = F.try_variant_get(current, "$", "double")
        if name not in HOURLY_SERIES:
            return current
        hourly = F.try_element_at(F.col(f"_doc.hourly.{name}"), F.col("_at"))
        return F.coalesce(current, hourly.try_cast("double"))

    location = ("city", "latitude", "longitude", "utc_offset_seconds", "timezone")
    readings = [reading(name).alias(name) for name in READINGS]
    payload = F.struct(
        *[F.col(f"_doc.{name}").alias(name) for name in location],
        F.struct(F.col("_seconds").alias("time"), *readings).alias("current"),
    )
    return timed.select(
        F.coalesce("_doc.city", F.lit("unknown")).alias("city"),
        fn.seconds_to_time(F.col("_seconds"), F.col("_missing"), now).alias("timestamp"),
        fn.time_status(F.col("_seconds"), F.col("_missing")).alias("time_status"),
        payload.alias("payload"),
        F.col("_doc.current.weather_code").isNull().alias("code_absent"),
        F.col("value").alias("payload_json"),
        is_object(F.col("value"), F.col("_doc._bad").isNotNull()).alias("valid"),
        *extra,
    )
