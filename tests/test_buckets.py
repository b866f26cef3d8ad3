"""Series operators over cut recordings against the same operators over whole ones."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import buckets as B
from tidemark.operators import joins
from tidemark.sources.shared import fresh_path

from . import plain_series as T

KEY = ["video", "camera"]


@pytest.fixture(scope="module")
def series(spark):
    """One recording holds half of all samples; times repeat, scores are null, one key is null and one has one sample."""
    rng = random.Random(5)
    rows = []
    for i in range(3_000):
        video = 1 if i % 2 else rng.choice([2, 3, 4, None])
        us = rng.choice([rng.randrange(0, 4_000), rng.randrange(3_000, 3_200)]) * 1_000
        rows.append((i, video, rng.choice("ab") if video != 1 else "a", us, None if rng.random() < 0.05 else float(rng.choice([0, 10, 55, 60, 60, 70, 90]))))
    rows += [(3_000, 9, "a", 5, 61.0), (3_001, 1, "a", None, 99.0), (3_002, 8, "a", 7, None)]
    df = spark.createDataFrame(rows, "event_id long, video long, camera string, us long, score double").repartition(5)
    return df.cache()


def same(got, want, digits=None):
    def rows(df):
        out = []
        for r in df.select(sorted(df.columns)).collect():
            out.append(repr([round(x, digits) if digits and isinstance(x, float) else x for x in r]))
        return sorted(out)

    assert rows(got) == rows(want)


@pytest.mark.parametrize(("rows", "key"), [(1, ["video"]), (90, KEY), (100_000, KEY)])
def test_segments_and_peaks(series, rows, key):
    known = series.where("us IS NOT NULL")
    for threshold, least in ((60.0, 0), (10.0, 3_000), (-1.0, 0)):
        same(B.segments(series, threshold, least, key, rows=rows), T.segments(known, threshold, least, key))
    for gap in (0, 20_000):
        same(B.peaks(series, 60.0, gap, key, rows=rows), T.peaks(known, 60.0, gap, key))


@pytest.mark.parametrize("rows", [40, 100_000])
def test_windows_means_and_differences(series, rows):
    known = series.where("us IS NOT NULL")
    for length in (1_000, 250_000, 9_000_000):
        same(B.best_window(series, length, KEY, rows=rows), T.best_window(known, length, KEY))
    same(B.best_window(series, 50_000, skip_zero=True, rows=rows), T.best_window(known, 50_000, skip_zero=True))
    for width in (5, 6, 300):
        want = known.withColumn("smooth", T.moving_average("score", width, KEY))
        same(B.smoothed(series, "score", width, KEY, rows=rows), want, 9)
    same(B.lag_difference(series, rows=rows), T.lag_difference(known))


@pytest.mark.parametrize("rows", [1, 60, 100_000])
def test_values_between_samples(series, rows):
    """Knots of one camera at the times of both: ties, null values, keys without knots and times before the first and after the last."""
    known = series.where("us IS NOT NULL")
    knots = series.where("camera = 'a' AND event_id % 3 = 0 AND (video <> 4 OR video IS NULL)")
    asked = known.where("event_id % 2 = 1 OR video <> 1 OR event_id < 20").select("event_id", "video", "us", F.lit("x").alias("extra"))
    same(B.interpolate(asked, knots, rows=rows), T.interpolate(asked, knots.where("us IS NOT NULL")), 9)
    timeless = series.where("us IS NULL").select("event_id", "video", "us")
    assert [r.interpolated for r in B.interpolate(timeless, knots, rows=rows).collect()] == [None]
    grid = known.select("video", (F.col("us") + F.col("event_id") % 1_500 - 700).alias("at")).unionByName(known.limit(5).select("video", F.lit(None).cast("long").alias("at")))
    for reach in (0, 400, 10**9):
        same(B.nearest(knots, grid, reach, rows=rows), T.nearest(knots.where("us IS NOT NULL"), grid, reach))


@pytest.mark.parametrize("rows", [1, 70, 100_000])
def test_sweeps(series, rows):
    known = series.where("us IS NOT NULL")
    for least in (0, 3_000):
        for key in (["video"], KEY):
            same(B.sweep(series, [-1, 10, 60, 85, 99], least, key, rows=rows), T.sweep(known, [-1, 10, 60, 85, 99], least, key))


@pytest.mark.parametrize("part_rows", [50, 10_000])
def test_scaling_to_maxima(series, part_rows, monkeypatch):
    monkeypatch.setattr(joins, "PART_ROWS", part_rows)
    shifted = series.withColumn("score", F.when(F.col("video") == 3, -F.col("score")).otherwise(F.col("score")))
    for key in (["video"], KEY):
        same(B.scaled_to_max(shifted, "score", key), shifted.withColumn("score", T.scale_to_max("score", key)), 9)


def greedy(rows, within, most):
    out = []
    for key in {r.video for r in rows}:
        taken = []
        for r in sorted((r for r in rows if r.video == key and r.score is not None and r.us is not None), key=lambda r: (-r.score, r.us)):
            if len(taken) < most and all(abs(r.us - x) >= within for x, _ in taken):
                taken.append((r.us, r.score))
        out += [(key, *x) for x in taken]
    return sorted(map(repr, out))


@pytest.mark.parametrize(("within", "most"), [(1, 4), (30_000, 1), (30_000, 6), (700_000, 40), (10**9, 4)])
def test_suppression(series, within, most, monkeypatch):
    monkeypatch.setattr(joins, "PART_ROWS", 100)
    assert sorted(map(repr, map(tuple, B.suppress(series, within, most).collect()))) == greedy(series.collect(), within, most)


def test_dealt_join(spark):
    many = spark.range(5_000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    one = many.where("k % 2 <> 0").groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("first"))
    for how in ("inner", "left"):
        want = many.join(one.drop("n"), "k", how)
        same(joins.dealt_join(many, one, "k", ["v"], "n", 5_000, how, part_rows=100), want)
        same(joins.dealt_join(many, one, "k", ["v"], "n", 5_000, how, part_rows=10_000), want)


def test_dealt_join_broadcasts_no_repeats(spark):
    """What is broadcast of the table with a row a key has no more rows than that table."""
    rows = spark.range(60_000).select((F.col("id") % 20_000).alias("k"), F.col("id").alias("v"))
    many = rows.unionByName(spark.range(30_000).select(F.lit(7).cast("long").alias("k"), F.col("id").alias("v")))
    path = fresh_path(spark, "one")
    many.groupBy("k").agg(F.count("*").alias("n")).write.parquet(path)
    got = joins.dealt_join(many, spark.read.parquet(path), "k", ["v"], "n", 90_000, "left")
    got.write.format("noop").mode("overwrite").save()
    assert got.count() == 90_000
    plan = joins.dealt_join(many, spark.read.parquet(path), "k", ["v"], "n", 90_000, "left").repartition(3)
    repeats = spark.read.parquet(path).withColumn("p", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / 1_000).cast("int") - 1))).count()
    assert repeats <= 20_000 + 90_000 // 1_000 and plan.count() == 90_000


def test_no_window_orders_a_recording_s_samples(series):
    """Windows over samples are by bucket; those by key alone are ordered by bucket: they see pieces or totals of buckets."""
    for made in (B.segments(series, 60.0, 0, rows=40), B.peaks(series, 60.0, 5, rows=40), B.best_window(series, 5_000, rows=40), B.lag_difference(series, rows=40), B.sweep(series, [60], 0, rows=40), B.interpolate(series.drop("score"), series, rows=40)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if " Window [" in line or line.strip().startswith("+- Window [")]
        assert windows
        for line in windows:
            assert "__b#" in line or "__kb#" in line, line


def test_empty_series(spark):
    none = spark.createDataFrame([], "event_id long, video long, camera string, us long, score double")
    for got in (B.segments(none, 1.0, 0), B.peaks(none, 1.0, 5), B.best_window(none, 5), B.smoothed(none, "score", 3), B.lag_difference(none), B.suppress(none, 5, 2), B.interpolate(none.drop("score"), none), B.nearest(none, none.select("video", F.col("us").alias("at")), 5), B.sweep(none, [1], 0), B.scaled_to_max(none, "score")):
        assert got.collect() == []


def test_long_keys_have_a_file_per_so_many_rows(spark, tmp_path):
    import os

    from tidemark.sources import writers as W

    df = spark.range(1_000).select("id", F.when(F.col("id") < 700, "long").otherwise(F.concat(F.lit("k"), (F.col("id") % 3).cast("string"))).alias("k"))
    for rows, files in ((100, range(7, 12)), (10_000, range(1, 2))):
        path = W.write_series(df, str(tmp_path / str(rows)), ["k"], file_rows=rows)
        assert sum(f.endswith(".parquet") for f in os.listdir(f"{path}/k=long")) in files
        assert sum(f.endswith(".parquet") for f in os.listdir(f"{path}/k=k0")) == 1
        assert sorted(map(tuple, spark.read.parquet(path).select("id", "k").collect())) == sorted(map(tuple, df.collect()))
