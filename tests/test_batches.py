"""Batches of exactly so many frames over restarts."""

from collections import Counter

from pyspark.sql import functions as F

from tidemark.plans import catalog
from tidemark.sources.shared import fresh_path
from tidemark.streaming import batches as B


def score(values):
    if any(v is None or v > 90 for v in values):
        raise ValueError("bad")
    return [v + len(values) / 100 for v in values]


def test_batches_are_full_and_remainders_are_carried_on(spark, tmp_path):
    rows = [(c, t * 1_000_000, 1000 * (c == "b") + t, 99.0 if c == "b" and t == 5 else float(t % 50)) for c, n in (("a", 23), ("b", 9)) for t in range(1, n + 1)]
    df = spark.createDataFrame(rows, "camera string, us long, event_id long, value double").withColumn("ts", F.timestamp_micros("us"))
    source, out = str(tmp_path / "in"), fresh_path(spark, "batches")

    def put(low, high):
        df.where((F.col("us") > low * 1_000_000) & (F.col("us") <= high * 1_000_000)).orderBy(F.rand(1)).repartition(3).write.mode("append").parquet(source)

    def follow():
        B.run(spark.readStream.schema(df.schema).parquet(source), score, out, 8, "2 seconds", 5_000_000)

    def got():
        return {r.event_id: r for r in spark.read.schema(B.ROWS).parquet(f"{out}/rows").where("camera <> 'end'").collect()}

    put(0, 7)
    follow()
    assert got() == {}  # no batch is full
    put(7, 13)
    follow()
    assert sorted(got()) == [*range(1, 9), *range(1001, 1009)] and all(r.batch_rows == 8 for r in got().values())
    assert all(r.scored == r.us / 1e6 + 0.08 for r in got().values() if r.camera == "a")
    put(13, 99)
    spark.createDataFrame([("end", 200_000_000, 9, 0.0)], "camera string, us long, event_id long, value double").withColumn("ts", F.timestamp_micros("us")).write.mode("append").parquet(source)
    follow()
    found = spark.read.schema(B.ROWS).parquet(f"{out}/rows").where("camera <> 'end'").collect()
    assert len(found) == 32 and Counter((r.camera, r.batch_rows) for r in found) == {("a", 8): 16, ("a", 7): 7, ("b", 8): 8, ("b", 1): 1}
    failed = {r.event_id: r.error for r in found if r.error}
    assert failed == {1005: "ValueError: bad"} and got()[1004].scored == 4.01 and got()[1009].scored == 9.01


def test_query_covers_all_cameras(spark):
    rows = catalog.QUERIES["stream_batches"](spark, "/root/testdata/sf0.001").collect()
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert len(rows) == events.count() and {r.camera for r in rows} == {r[0] for r in events.select("event_type").distinct().collect()}
