"""What the refresh queries cost on a dense station."""

import pytest
from pyspark.sql import functions as F

from obsweave.checks import extended, queries
from obsweave.operators import series


@pytest.fixture
def no_sliding_frame(monkeypatch):
    """A sliding frame costs the rows in it for every row, which a dense station has many of."""

    def slides(*_):
        raise AssertionError("sliding frame over a dense station")

    monkeypatch.setattr(series, "hours_frame", slides)


@pytest.mark.parametrize("query", [queries.refresh_equals_full, extended.indexed_refresh])
def test_refresh_of_a_dense_station_slides_no_frame(spark, sf_dir, query, no_sliding_frame):
    found = query(spark, sf_dir).first()
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert found.asDict() == {"rows": events.count() + events.select(F.count_distinct("ts")).first()[0], "differing": 0}


def test_refreshed_table_slides_no_frame(spark, sf_dir, no_sliding_frame):
    found = queries.incremental_features(spark, sf_dir)
    assert found.count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()
