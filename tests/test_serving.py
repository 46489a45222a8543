"""Read queries: ranges, limits, guards, fallbacks."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from obsweave.operators import latest
from obsweave.plans import serving, training

AS_OF = datetime(2025, 6, 15, 12)


@pytest.fixture(scope="module")
def obs(spark):
    rows = [
        (city, AS_OF - timedelta(hours=h), base + h, 50.0, 1010.0, 3.0)
        for city, base in (("Madrid", 20.0), ("Palma", 10.0))
        for h in range(-1, 30)
    ]
    flat = spark.createDataFrame(
        rows, "city string, timestamp timestamp, t double, h double, p double, w double"
    )
    return flat.select(
        "city",
        "timestamp",
        F.struct(
            F.struct(
                F.col("t").alias("temp"),
                F.col("t").alias("feels_like"),
                F.col("h").alias("humidity"),
                F.col("p").alias("pressure"),
            ).alias("main"),
            F.struct(F.col("w").alias("speed")).alias("wind"),
            F.array(F.struct(F.lit("fog").alias("description"))).alias("weather"),
        ).alias("data"),
    )


def test_current(obs):
    row = serving.current(obs, "Madrid").first()
    assert (row.temperature, row.description) == (19.0, "fog")
    assert serving.current(obs, "Nowhere").isEmpty()
    assert [r.city for r in serving.cities(obs).collect()] == ["Madrid", "Palma"]
    assert {r.city: r.temperature for r in serving.current_all(obs).collect()} == {
        "Madrid": 19.0,
        "Palma": 9.0,
    }


def test_history_is_closed_newest_first_and_limited(obs):
    rows = serving.history(obs, "Madrid", hours=3, as_of=AS_OF).collect()
    assert [r.temperature for r in rows] == [20, 21, 22, 23]
    assert serving.history(obs, "Madrid", 3, limit=2, as_of=AS_OF).count() == 2
    assert serving.history(obs, "Madrid", 1).isEmpty()  # now is far from the data


def test_statistics(obs):
    row = serving.statistics(obs, "Palma", 2, AS_OF).first()
    assert (row.avg_temperature, row.min_temperature, row.max_temperature) == (11.0, 10.0, 12.0)
    assert (row.total_records, row.period_hours) == (3, 2)
    assert (row.start_time, row.end_time) == (AS_OF - timedelta(hours=2), AS_OF)
    assert serving.statistics(obs, hours=2, as_of=AS_OF).count() == 2


def test_rounding_to_two_digits(spark):
    rows = [("a", AS_OF, 1.0), ("a", AS_OF, 1.0), ("a", AS_OF, 2.0)]
    flat = spark.createDataFrame(rows, "city string, timestamp timestamp, temperature double")
    found = serving.statistics(flat, as_of=AS_OF).first()
    assert (found.avg_temperature, found.avg_humidity) == (1.33, None)


def test_compare(obs):
    rows = serving.compare(obs, " Palma, Madrid,Madrid , Nowhere", 2, AS_OF).collect()
    assert [(r.city, r.avg_temperature, r.data_points) for r in rows] == [
        ("Madrid", 21.0, 3),
        ("Palma", 11.0, 3),
    ]
    with pytest.raises(ValueError):
        serving.compare(obs, "Madrid", 2, AS_OF)


@pytest.mark.parametrize("hours", [0, 169])
def test_hours_are_bounded(obs, hours):
    with pytest.raises(ValueError):
        serving.statistics(obs, "Madrid", hours)


def test_limits_are_bounded(obs):
    with pytest.raises(ValueError):
        serving.history(obs, "Madrid", limit=1001)
    with pytest.raises(ValueError):
        serving.city_predictions(obs, "Madrid", 501)


def test_description_defaults(spark):
    flat = spark.createDataFrame(
        [("a", AS_OF, 1.0)], "city string, timestamp timestamp, temperature double"
    )
    row = serving.current(flat, "a").first()
    assert (row.description, row.humidity) == ("N/A", None)


def test_newest_rows_keep_ties_and_newest_row_does_not(spark):
    rows = [("a", AS_OF, 1), ("a", AS_OF, 2), ("a", AS_OF - timedelta(1), 3), ("b", AS_OF, 4)]
    frame = spark.createDataFrame(rows, "city string, timestamp timestamp, v int")
    assert sorted(r.v for r in latest.newest_rows(frame).collect()) == [1, 2, 4]
    one = latest.newest_row(frame, tie_break=[F.col("v").desc()])
    assert sorted(r.v for r in one.collect()) == [2, 4]


def test_newest_row_prunes_before_its_shuffle(obs):
    plan = latest.newest_row(obs)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_latest_entry_by_prefix(spark):
    rows = [
        ("temp_prediction_1h_A", AS_OF, "1"),
        ("temp_prediction_1h_B", AS_OF + timedelta(1), "2"),
        ("rain_prediction_1h_C", AS_OF + timedelta(2), "3"),
    ]
    registry = spark.createDataFrame(rows, "model_name string, timestamp timestamp, version string")
    assert training.latest_entry(registry, "temp_prediction_1h").first().version == "2"
    assert training.latest_entry(registry, "wind").isEmpty()


def test_newest_rows_read_only_their_days(spark, tmp_path, capsys):
    from obsweave.operators.keyed import with_day, write_days

    rows = [(c, datetime(2025, 6, d), float(d)) for c, last in (("a", 9), ("b", 3)) for d in range(1, last + 1)]
    table = spark.createDataFrame(rows, "city string, timestamp timestamp, temperature double")
    write_days(with_day(table), str(tmp_path / "t"), "overwrite")
    newest = serving.current_all(spark.read.parquet(str(tmp_path / "t")))
    assert sorted((r.city, r.temperature) for r in newest.collect()) == [("a", 9.0), ("b", 3.0)]
    newest.explain()
    assert "PartitionFilters: [day" in capsys.readouterr().out.replace("isnotnull(day", "day")
