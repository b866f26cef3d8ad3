"""The index sink over crashes, and two series merged over a stream."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from tidemark.operators import timeseries as T
from tidemark.plans import catalog
from tidemark.sources import index_sink as I
from tidemark.sources.shared import fresh_path
from tidemark.streaming import interpolation as N

SF = "/root/testdata/sf0.001"


def test_a_killed_run_leaves_one_row_an_event(spark, tmp_path):
    source, index, state = f"{tmp_path}/in", f"{tmp_path}/index", f"{tmp_path}/state"
    shape = "event_id long, status string"

    def put(low, high):
        spark.range(low, high).select(F.col("id").alias("event_id"), F.lit("extracted").alias("status")).repartition(3).write.mode("append").parquet(source)

    def resume():
        I.append(spark.readStream.schema(shape).parquet(source), index, state).awaitTermination()

    def ids():
        return sorted(r.event_id for r in I.published(spark, index, shape).collect())

    def forget():
        """The stream's own note that batch 1 is done."""
        for name in ("1", ".1.crc"):
            os.remove(f"{state}/commits/{name}")

    assert ids() == []
    put(0, 10)
    resume()
    put(10, 25)
    resume()
    assert ids() == list(range(25)) and len(os.listdir(f"{index}/batches")) == 2
    parts = len(os.listdir(f"{index}/parts"))
    # killed after the batch was published but before the stream noted it
    forget()
    resume()
    assert ids() == list(range(25)) and len(os.listdir(f"{index}/parts")) == parts
    # killed between the parts and the ledger: the lost attempt's parts lie there, unlisted
    forget()
    os.remove(f"{index}/batches/{1:012d}.json")
    assert ids() == list(range(10))
    resume()
    assert ids() == list(range(25)) and len(os.listdir(f"{index}/parts")) > parts
    put(25, 26)
    resume()
    assert ids() == list(range(26)) and {r.batch for r in I.published(spark, index, shape).where("event_id = 25").collect()} == {2}
    failing = spark.readStream.schema(shape).parquet(source).withColumn("status", F.when(F.col("event_id") > 24, F.raise_error(F.lit("lost"))).otherwise(F.col("status")))
    shutil.copytree(index, f"{tmp_path}/other")
    with pytest.raises(Exception, match="lost|failed|FAILED"):
        I.append(failing, f"{tmp_path}/other", f"{tmp_path}/fresh").awaitTermination()
    assert sorted(r.event_id for r in I.published(spark, f"{tmp_path}/other", shape).collect()) == list(range(26))


def test_two_series_over_files_in_disorder_equal_the_batch(spark, tmp_path):
    rows = [(v, t * 1_000_000 + 500_000, 100 * v + t) for v in (1, 2, 3) for t in range(1, 40) if (t + v) % 3]
    knots = [(v, t * 1_000_000, 1000 * v + t, None if t == 8 else float(t * t % 17)) for v in (1, 2) for t in range(3, 36, 5)] + [(1, 13_500_000, 1999, 5.0)]
    one = spark.createDataFrame(rows, "video long, us long, event_id long").withColumn("ts", F.timestamp_micros("us"))
    two = spark.createDataFrame(knots, "video long, us long, event_id long, value double").withColumn("ts", F.timestamp_micros("us"))
    want = T.interpolate(one.select("video", "us", "event_id"), two.select("video", "us", "event_id", F.col("value").alias("score")))
    expected = sorted(map(tuple, want.select("video", "us", "event_id", "interpolated").collect()))
    out = fresh_path(spark, "merged")
    folders = f"{tmp_path}/rows", f"{tmp_path}/knots"

    def put(low, high):
        for df, folder in ((one, folders[0]), (two, folders[1])):
            df.where((F.col("us") >= low) & (F.col("us") < high)).orderBy(F.rand(2)).repartition(3).write.mode("append").parquet(folder)

    def merge():
        streams = (spark.readStream.schema(df.schema).parquet(f) for df, f in ((one, folders[0]), (two, folders[1])))
        return N.run(*streams, out, "4 seconds", 10_000_000)

    def got():
        return sorted(map(tuple, spark.read.schema(N.ROWS).parquet(f"{out}/rows").where("video < 9").collect()))

    put(0, 15_000_000)
    merge()
    early = got()
    assert 0 < len(early) < len(expected) and set(early) <= set(expected)
    put(15_000_000, 10**9)
    spark.createDataFrame([(9, 200_000_000, 5)], "video long, us long, event_id long").withColumn("ts", F.timestamp_micros("us")).write.mode("append").parquet(folders[0])
    merge()
    assert [tuple(pytest.approx(x) if isinstance(x, float) else x for x in r) for r in expected] == got()
    # a row that is too late changes nothing and is counted
    one.limit(1).withColumn("event_id", F.lit(77).cast("long")).write.mode("append").parquet(folders[0])
    dropped = sum(s.numRowsDroppedByWatermark for p in merge().recentProgress for s in p.stateOperators)
    assert dropped == 1 and len(got()) == len(expected)


def test_query_of_the_stream_equals_the_batch_s(spark):
    a, b = (sorted(map(tuple, catalog.QUERIES[n](spark, SF).select("event_id", "interpolated").collect()), key=lambda r: r[0]) for n in ("interp_join", "stream_interpolation"))
    assert len(a) > 50 and a == b


def test_a_scratch_part_goes_with_its_tables(spark):
    from tidemark.sources import shared

    with shared.scratch(spark) as path:
        rows = catalog.QUERIES["best_window"](spark, SF).collect()
        made = os.listdir(path.removeprefix("file://"))
    assert rows and made and not os.path.exists(path.removeprefix("file://"))
    assert not shared.fresh_path(spark, "x").startswith(path)
