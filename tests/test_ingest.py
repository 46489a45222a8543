"""Message decode, keyed tables, backfill and the stream that feeds them."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from obsweave.operators.keyed import compact, insert_if_absent, read_days, upsert
from obsweave.sources import backfill, messages
from obsweave.sources.tables import flatten, observed, read_raw
from obsweave.streaming import ingest

T0 = 1_750_000_000


def message(city="Madrid", time=T0, **current):
    doc = {
        "city": city,
        "latitude": 40.4168,
        "longitude": -3.7038,
        "utc_offset_seconds": 3600,
        "timezone": "Europe/Madrid",
        "current": {"time": time, "temperature_2m": 22.5, "relative_humidity_2m": 55}
        | {"weather_code": 1}
        | current,
    }
    return doc


def as_messages(spark, docs, sequence=0):
    rows = [
        (d if isinstance(d, str) else json.dumps(d), datetime(2025, 6, 15, 16), sequence + i)
        for i, d in enumerate(docs)
    ]
    return spark.createDataFrame(rows, "value string, received_at timestamp, sequence bigint")


def parse_one(spark, doc):
    parsed = messages.parse(as_messages(spark, [doc]), now=F.lit(datetime(2030, 1, 1)))
    return parsed.withColumn("unix", F.unix_timestamp("timestamp")).first()


def test_unix_seconds_are_utc(spark):
    row = parse_one(spark, message())
    assert (row.unix, row.time_status, row.valid) == (T0, "ok", True)
    assert row.payload.current.relative_humidity_2m == 55.0


@pytest.mark.parametrize(
    "time, unix, status",
    [
        (str(T0), T0, "ok"),
        (T0 + 0.7, T0, "ok"),
        ("bad", 1893456000, "invalid"),
        ("12.5", 1893456000, "invalid"),
        (None, 1893456000, "invalid"),
        (10**15, 1893456000, "invalid"),
    ],
)
def test_time_fallbacks(spark, time, unix, status):
    row = parse_one(spark, message(time=time))
    assert (row.unix, row.time_status) == (unix, status)


def test_absent_time_is_epoch_and_absent_city_is_unknown(spark):
    row = parse_one(spark, {"current": {"temperature_2m": 1}})
    assert (row.unix, row.time_status, row.city) == (0, "missing", "unknown")


def test_wrong_type_spoils_only_its_field(spark):
    row = parse_one(spark, message(temperature_2m="warm", cape=3))
    assert row.valid and row.payload.current.temperature_2m is None
    assert row.payload.current.cape == 3.0


@pytest.mark.parametrize("text", ["{broken", "[1, 2]", '"text"', "", "null"])
def test_non_objects_are_invalid(spark, text):
    assert parse_one(spark, text).valid is False


def test_missing_current_value_comes_from_the_hour(spark):
    doc = message(time=T0)
    hour = T0 - T0 % 3600
    doc["hourly"] = {
        "time": [hour - 3600, hour, hour + 3600],
        "cape": [1, 2, 3],
        "temperature_2m": [0, 0, 0],
    }
    current = parse_one(spark, doc).payload.current
    assert (current.cape, current.temperature_2m, current.wind_speed_80m) == (2.0, 22.5, None)


@pytest.mark.parametrize(
    "code, text",
    [(0, "clear sky"), (95, "thunderstorm"), (998, "weather code 998"), (None, "weather code None")],
)
def test_snapshot_describes_code(spark, code, text):
    parsed = messages.parse(
        as_messages(spark, [message(weather_code=code)]), extra=["sequence"]
    )
    row = ingest.snapshot_rows(parsed).first()
    assert row.data.weather[0].description == text
    assert row.id == f"Madrid_{T0}"
    assert row.data.main.temp == 22.5


def test_snapshot_absent_code_reads_as_zero(spark):
    doc = message()
    del doc["current"]["weather_code"]
    parsed = messages.parse(as_messages(spark, [doc]), extra=["sequence"])
    weather = ingest.snapshot_rows(parsed).first().data.weather[0]
    assert (weather.id, weather.description) == (None, "clear sky")


def test_upsert_last_write_wins_and_replay_is_harmless(spark, tmp_path):
    path = str(tmp_path / "t")

    def batch(*rows):
        frame = spark.createDataFrame(rows, "city string, t bigint, v int, seq int")
        return frame.withColumn("timestamp", F.timestamp_seconds("t")).drop("t")

    first = batch(("a", T0, 1, 1), ("a", T0, 2, 2), ("b", T0, 3, 3), ("a", T0 + 86400 * 3, 4, 4))
    second = batch(("a", T0, 9, 5), ("c", T0, 8, 6))
    for rows in (first, second, second):
        upsert(rows, path, order="seq")
    found = {(r.city, r.t): r.v for r in read_days(spark, path).withColumn("t", F.unix_timestamp("timestamp")).collect()}
    assert found == {("a", T0): 9, ("b", T0): 3, ("c", T0): 8, ("a", T0 + 86400 * 3): 4}
    assert read_days(spark, path).count() == 4


def test_upsert_rewrites_only_parts_that_hold_a_key_already(spark, tmp_path):
    path = tmp_path / "t"

    def write(*rows):
        frame = spark.createDataFrame(rows, "city string, t bigint, v int")
        timed = frame.withColumn("timestamp", F.timestamp_seconds("t")).drop("t")
        upsert(timed, str(path), order="v", drop=["v"], parts=4)

    def files():
        return {(d.parent.name, d.name): {f.name for f in d.glob("*.parquet")} for d in path.glob("day=*/part=*")}

    write(*[(c, T0 + 86400 * d, 1) for c in "abcdefgh" for d in (0, 1)])
    before = files()
    write(("new", T0, 1), ("a", T0 + 86400, 2))
    after = files()
    rewritten = {place for place in before if not before[place] & after[place]}
    grown = {place for place in after if before.get(place, set()) < after[place]}
    assert len(rewritten) == len(grown) == 1 and len(before) > 4
    assert all(before[place] == after[place] for place in before if place not in rewritten | grown)
    assert next(iter(rewritten))[0] > next(iter(grown))[0]
    table = read_days(spark, str(path))
    assert table.count() == 17 and "v" not in table.columns
    compact(spark, str(path), [r[0] for r in table.select("day").distinct().collect()])
    assert all(len(names) == 1 for names in files().values())
    assert read_days(spark, str(path)).count() == 17


def test_stored_order_keeps_late_writes_out(spark, tmp_path):
    path = str(tmp_path / "t")

    def write(value, seq):
        rows = spark.createDataFrame([(None, T0, value, seq)], "city string, t bigint, v int, seq int")
        upsert(rows.withColumn("timestamp", F.timestamp_seconds("t")).drop("t"), path, order="seq")

    for value, seq in ((1, 5), (2, 9), (3, 7)):
        write(value, seq)
    assert [r.v for r in read_days(spark, path).collect()] == [2]  # null keys match as well


def test_topic_time_orders_across_partitions(spark, tmp_path):
    where = ingest.Tables.under(str(tmp_path))
    rows = []
    for when, partition, offset, temperature in ((100, 0, 900, 1.0), (200, 1, 7, 2.0)):
        doc = {"city": "a", "current": {"time": T0, "temperature_2m": temperature}}
        rows.append((" \n" + json.dumps(doc) + "\r\n", when, partition, offset))
    rows.append(("[1]", 100, 0, 901))
    frame = spark.createDataFrame(rows, "value string, at bigint, p int, o bigint").withColumn("received_at", F.timestamp_seconds("at"))
    batch = frame.select("value", "received_at", messages.sequence(F.col("received_at"), F.col("p"), F.col("o")))
    for part in (batch, batch.where("p = 0"), batch):
        ingest.store_batch(part, where)
    stored = read_days(spark, where.current).collect()
    assert [r.data.main.temp for r in stored] == [2.0]
    assert read_days(spark, where.dead_letter).count() == 1


def test_decoding_stands_in_the_plan_once(spark, capsys):
    texts = spark.createDataFrame([("{}",)], "value string")
    messages.parse(texts.withColumn("sequence", F.lit(0))).where("valid").explain("extended")
    plan = capsys.readouterr().out
    assert plan[plan.index("Optimized Logical Plan"):plan.index("Physical Plan")].count("from_json") == 1


def test_backfill_keeps_what_does_not_parse(spark, tmp_path):
    good = {"city": None, "hourly": {"time": [T0, 10**17, None], "temperature_2m": [1.0, 2.0, 3.0]}}
    texts = [json.dumps(good), "no json", "[1]", json.dumps({"city": "a"})]
    batch = spark.createDataFrame([(t,) for t in texts], "value string")
    raw, letters = str(tmp_path / "raw"), str(tmp_path / "letters")
    assert backfill.backfill(batch, raw, letters) == (1, 0)
    assert backfill.backfill(batch, raw, letters) == (0, 1)
    assert [r.city for r in read_days(spark, raw).collect()] == ["unknown"]
    reasons = sorted(r.reason for r in read_days(spark, letters).collect())
    assert reasons == ["no usable time series", "not a JSON object", "not a JSON object", "unusable times"]


def test_insert_if_absent_keeps_the_first(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", T0, 5, 2), ("a", T0, 4, 1), (None, T0, 1, 3)], "city string, t bigint, v int, seq int")
    rows = rows.withColumn("timestamp", F.timestamp_seconds("t")).drop("t")
    assert insert_if_absent(rows, path, order="seq") == (2, 1)
    assert insert_if_absent(rows, path, order="seq") == (0, 3)
    assert sorted(r.v for r in read_days(spark, path).collect()) == [1, 4]


def test_upsert_needs_the_time_in_its_key(spark, tmp_path):
    rows = spark.createDataFrame([("a", datetime(2025, 1, 1))], "city string, timestamp timestamp")
    with pytest.raises(ValueError):
        upsert(rows, str(tmp_path / "t"), keys=("city",))


def historical(city, times, **series):
    return {
        "city": city,
        "latitude": 1.0,
        "elevation": 12.0,
        "hourly": {"time": times, **series},
    }


def test_backfill_expands_and_inserts_once(spark, tmp_path):
    path = str(tmp_path / "raw")
    times = [T0 + 3600 * i for i in range(5)]
    docs = [
        historical("Madrid", times, temperature_2m=[1, 2, None, 4, 5], rain=[0.5, 0.5]),
        historical("Palma", [], temperature_2m=[]),
    ]
    batch = as_messages(spark, docs)
    assert backfill.backfill(batch, path) == (5, 0)
    assert backfill.backfill(batch, path) == (0, 5)
    rows = flatten(observed(read_raw(spark, path))).orderBy("timestamp").collect()
    assert [r.temperature for r in rows] == [1.0, 2.0, None, 4.0, 5.0]
    assert [r.rain for r in rows] == [0.5, 0.5, None, None, None]
    assert all(r.humidity is None and r.latitude == 1.0 for r in rows)
    meta = read_raw(spark, path).first().hourly_meta
    assert float(meta["elevation"]) == 12.0 and not {"hourly", "city"} & set(meta)


def test_backfill_keeps_live_rows_and_live_replaces_backfill(spark, tmp_path):
    tables = ingest.Tables.under(str(tmp_path))
    ingest.store_batch(as_messages(spark, [message(temperature_2m=30)]), tables)
    doc = historical("Madrid", [T0, T0 + 3600], temperature_2m=[1, 2])
    assert backfill.backfill(as_messages(spark, [doc]), tables.raw) == (1, 1)
    ingest.store_batch(as_messages(spark, [message(time=T0 + 3600, temperature_2m=31)]), tables)
    rows = flatten(read_raw(spark, tables.raw)).orderBy("timestamp").collect()
    assert [r.temperature for r in rows] == [30.0, 31.0]


def test_insert_if_absent_counts_copies_in_the_batch(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", datetime(2025, 1, 1), 1), ("a", datetime(2025, 1, 1), 2)],
        "city string, timestamp timestamp, v int",
    )
    assert insert_if_absent(rows, str(tmp_path / "t"), order="v") == (1, 1)


def run_stream(spark, source, tables, checkpoint):
    stream = messages.stream_files(spark, source)
    query = ingest.start_ingest(stream, tables, checkpoint, availableNow=True)
    query.awaitTermination()
    assert query.exception() is None


def test_stream_dual_write_dead_letters_and_restart(spark, tmp_path):
    source, tables = tmp_path / "in", ingest.Tables.under(str(tmp_path / "out"))
    source.mkdir()
    lines = [json.dumps(message()), json.dumps(message("Palma")), "{broken", json.dumps(message())]
    (source / "a.json").write_text("\n".join(lines))
    run_stream(spark, str(source), tables, str(tmp_path / "cp"))
    assert read_days(spark, tables.raw).count() == 2
    assert read_days(spark, tables.current).count() == 2
    assert [r.value for r in read_days(spark, tables.dead_letter).collect()] == ["{broken"]

    (source / "b.json").write_text(json.dumps(message(temperature_2m=40)))
    run_stream(spark, str(source), tables, str(tmp_path / "cp"))
    raw = {r.city: r.payload.current.temperature_2m for r in read_raw(spark, tables.raw).collect()}
    assert raw == {"Madrid": 40.0, "Palma": 22.5}
    assert read_days(spark, tables.dead_letter).count() == 1

    # a lost checkpoint replays everything and changes nothing
    run_stream(spark, str(source), tables, str(tmp_path / "cp2"))
    raw = {r.city: r.payload.current.temperature_2m for r in read_raw(spark, tables.raw).collect()}
    assert raw == {"Madrid": 40.0, "Palma": 22.5}


def test_encoded_messages_decode_to_the_same_rows(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.5, None), ("b", None, 2)], "city string, x double, y int")
    encoded = messages.encode(rows)
    assert [r.key for r in encoded.collect()] == ["a", "b"]
    messages.publish(encoded.select("value"), format="text", path=str(tmp_path / "out"))
    back = spark.read.schema(rows.schema).json(str(tmp_path / "out"))
    assert sorted(back.collect()) == sorted(rows.collect())
    assert datetime.fromtimestamp(T0, tz=timezone.utc).hour == 15
