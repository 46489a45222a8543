"""As-of and interval joins, ranks and levels against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from obsweave.operators import asof, intervals, ranking, sketches
from obsweave.plans import rollups
from obsweave.session import scratch_path

START = datetime(2025, 1, 1)


def some_times(draw, n, span=400):
    return [START + timedelta(minutes=30 * draw.randrange(2 * span)) for _ in range(n)]


def made(seed, n_left=150, n_right=60):
    draw = random.Random(seed)
    left = [(draw.choice(["a", "b", "hot", "hot", None]), t if draw.random() < 0.95 else None, i) for i, t in enumerate(some_times(draw, n_left))]
    right = {(draw.choice(["a", "hot", "hot", "c"]), t) for t in some_times(draw, n_right)}
    right = [(c, t, float(i)) for i, (c, t) in enumerate(sorted(right))] + [(None, START, -1.0), ("hot", None, -2.0)]
    return left, right


@pytest.mark.parametrize("direction", ["forward", "backward"])
@pytest.mark.parametrize("tolerance", [None, 30])
@pytest.mark.parametrize("bucket", [1, 24, 100000])
def test_asof(spark, direction, tolerance, bucket):
    left, right = made(bucket)
    lefts = spark.createDataFrame(left, "city string, timestamp timestamp, row bigint")
    rights = spark.createDataFrame(right, "city string, timestamp timestamp, found double")
    joined = asof.asof_join(lefts, rights, {"hit": "timestamp", "key": "found"}, direction=direction, tolerance_hours=tolerance, bucket_hours=bucket)
    assert joined.columns == ["city", "timestamp", "row", "hit", "key"]
    want = []
    for city, time, row in left:
        near = [(t, v) for c, t, v in right if None not in (city, time, t) and c == city and (t >= time if direction == "forward" else t <= time)]
        near = [x for x in near if tolerance is None or abs(x[0] - time) <= timedelta(hours=tolerance)]
        hit = (min(near) if direction == "forward" else max(near)) if near else (None, None)
        want.append((city, time, row, *hit))
    assert sorted(map(tuple, joined.collect()), key=lambda r: r[2]) == want


def test_asof_of_nothing(spark):
    left, right = made(1)
    lefts = spark.createDataFrame(left, "city string, timestamp timestamp, row bigint")
    rights = spark.createDataFrame(right, "city string, timestamp timestamp, found double")
    none = asof.asof_join(lefts, rights.limit(0), {"v": "found"})
    assert none.count() == len(left) and none.where("v is not null").isEmpty()
    assert asof.asof_join(lefts.limit(0), rights, {"v": "found"}).isEmpty()


def test_asof_spreads_a_hot_station(spark):
    """The window's partitions of a station are as many as its buckets."""
    rows = spark.range(24 * 30).select(F.lit("hot").alias("city"), (F.lit(START).cast("timestamp") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("timestamp"), F.col("id").cast("double").alias("v"))
    joined = asof.asof_join(rows, rows, {"w": "v"}, bucket_hours=24)
    assert joined.where("v = w").count() == 24 * 30
    plan = joined._jdf.queryExecution().toString()
    assert "hashpartitioning(key" in plan and "bucket" in plan.split("hashpartitioning(key")[1][:40]


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("bins", [1, 24, 10000])
def test_intervals(spark, how, bins):
    draw = random.Random(bins)
    points, _ = made(bins, 120)
    starts = some_times(draw, 40)
    held = [(draw.choice(["a", "hot", None]), s, s + timedelta(hours=draw.choice([-3, 0, 1, 5, 60, 5000])), i) for i, s in enumerate(starts)]
    held += [("a", None, START, 98), ("a", START, None, 99)]
    p = spark.createDataFrame(points, "city string, timestamp timestamp, bin bigint")
    i = spark.createDataFrame(held, "city string, start timestamp, end timestamp, first bigint")
    met = intervals.interval_join(p, i, how=how, bin_hours=bins)
    got = sorted(((*r[:3], r.interval and r.interval.first) for r in met.collect()), key=str)
    want = []
    for city, time, row in points:
        hits = [n for c, s, e, n in held if None not in (city, time, s, e) and c == city and s <= time <= e]
        want += [(city, time, row, n) for n in hits] or ([(city, time, row, None)] if how == "left" else [])
    assert got == sorted(want, key=str)


def test_a_long_interval_is_many_light_rows(spark):
    p = spark.range(1000).select(F.lit("a").alias("city"), (F.lit(START).cast("timestamp") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("timestamp"))
    i = spark.createDataFrame([("a", START, START + timedelta(days=400), 1)], "city string, start timestamp, end timestamp, n bigint")
    met = intervals.interval_join(p, i)
    assert met.count() == 1000
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_positions_and_ranks(spark):
    draw = random.Random(1)
    rows = [(draw.choice("xy"), draw.choice([1.5, 2.5, 2.5, None, float(draw.randrange(50))]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v double, _position bigint").repartition(7)
    placed = ranking.with_position(df, [F.col("v").desc_nulls_last(), "_position"], ["g"], "at").collect()
    for g in "xy":
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        assert [tuple(r)[:3] for r in sorted((r for r in placed if r.g == g), key=lambda r: r["at"])] == own
        assert sorted(r["at"] for r in placed if r.g == g) == list(range(len(own)))
    ranked = ranking.with_ranks(df, "v", ["g"]).collect()
    assert len(ranked) == 400
    for r in ranked:
        order = sorted((x[1] is None, x[1] or 0) for x in rows if x[0] == r.g)
        mine = (r.v is None, r.v or 0)
        least, most = order.index(mine), len(order) - 1 - order[::-1].index(mine)
        assert (r.rank, r.average_rank) == (least + 1, (least + most) / 2 + 1)
        assert r.percent_rank == pytest.approx(least / (len(order) - 1))
    assert ranking.with_ranks(df.limit(0), "v").collect() == []
    one = ranking.with_ranks(df.limit(1), "v").first()
    assert (one["rank"], one.percent_rank) == (1, 0.0)


def test_auc_by_rank(spark):
    draw = random.Random(2)
    rows = [(float(draw.random() < 0.3), float(draw.randrange(20))) for _ in range(300)]
    scored = spark.createDataFrame(rows + [(None, 1.0), (1.0, None)], "label double, score double")
    pairs = [(a, b) for la, a in rows if la for lb, b in rows if not lb]
    want = sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs)
    assert ranking.auc_by_rank(scored).first().auc_roc == pytest.approx(want)
    assert ranking.auc_by_rank(scored.where("label = 1")).first().auc_roc is None


def test_sketches_stay_within_their_bound(spark):
    rows = spark.range(60_000).select(
        F.lit("a").alias("city"),
        (F.lit(START).cast("timestamp") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("timestamp"),
        F.when(F.col("id") % 100 == 0, F.lit(float("nan"))).when(F.col("id") % 100 != 1, F.rand(4) ** 3).alias("v"),
        F.pmod(F.xxhash64("id"), F.lit(5000)).alias("code"),
    )
    rows = rows.checkpoint()
    path = scratch_path(spark, "sketches")
    sketches.refresh_sketches(rows, rows, path, "v", "code")
    found = sketches.estimates(sketches.in_days(spark, path), ranks=[0.05, 0.5, 0.95]).first()
    exact = sorted(r.v for r in rows.where("v is not null and not isnan(v)").collect())
    assert found.n == len(exact) == 58_800
    for rank, value in ((0.05, found.q5), (0.5, found.q50), (0.95, found.q95)):
        true = sum(v <= value for v in exact) / len(exact)
        assert abs(true - rank) <= sketches.RANK_ERROR
    assert abs(found.distinct - 5000) / 5000 < 0.05
    with pytest.raises(ValueError):
        sketches.in_days(spark, path + "x")


def test_levels(spark):
    rows = [(c, START + timedelta(hours=h, minutes=m), float(h + m)) for c in ("a", None) for h in (0, 1, 30, 800) for m in (0, 30)]
    obs = spark.createDataFrame(rows, "city string, timestamp timestamp, temperature double")
    found = rollups.level_statistics(obs)
    counts = {level: found.where(F.col("level") == level).count() for level in rollups.LEVELS}
    assert counts == {"hour": 8, "day": 6, "month": 4, "city": 2, "all": 1}
    total = found.where("level = 'all'").first()
    assert (total.rows, total["min"], total["max"], total.start) == (16, 0.0, 830.0, None)
    assert rollups.level_statistics(obs, levels=("day",)).count() == 6
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Expand" in plan
    with pytest.raises(ValueError):
        rollups.level_statistics(obs, levels=("year",))
