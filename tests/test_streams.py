"""Streams: what a watermark closes and drops, and ties of time in keyed state."""

import datetime as dt
import os

from tidemark.operators import timeseries
from tidemark.sources.shared import fresh_path
from tidemark.streaming import segments, sessions, state

START = dt.datetime(2024, 1, 1)


def write(spark, folder, name, rows, at):
    """One Parquet file of (video, hours, score) whose place in the stream is ``at``."""
    made = [(v, START + dt.timedelta(hours=h), s) for v, h, s in rows]
    spark.createDataFrame(made, "user_id long, ts timestamp, value double").coalesce(1).write.parquet(f"{folder}/raw-{name}")
    part = next(f for f in os.listdir(f"{folder}/raw-{name}") if f.endswith(".parquet"))
    os.makedirs(f"{folder}/in", exist_ok=True)
    os.rename(f"{folder}/raw-{name}/{part}", f"{folder}/in/{name}.parquet")
    os.utime(f"{folder}/in/{name}.parquet", (at, at))


def test_a_watermark_gives_out_closed_chains_and_drops_late_rows(spark, tmp_path):
    write(spark, tmp_path, "a", [(1, 0, 90.0), (1, 1, 80.0), (1, 2, 10.0)], 1000)
    write(spark, tmp_path, "b", [(1, 240, 70.0)], 2000)
    write(spark, tmp_path, "c", [(1, 241, 65.0)], 3000)
    write(spark, tmp_path, "d", [(1, 24, 99.0), (1, 720, 95.0)], 4000)
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").selectExpr("user_id AS video", "ts", "value AS score")
    out = fresh_path(spark, "append")
    run = sessions.peak_sessions(raw, 60.0, "12 hours").writeStream.outputMode("append").option("checkpointLocation", f"{out}/state").option("path", f"{out}/rows").format("parquet").trigger(availableNow=True).start()
    run.awaitTermination()
    got = sorted((r.start, r.n, r.top) for r in spark.read.parquet(f"{out}/rows").collect())
    # hour 24 came when the batch before had begun at a watermark of day 9; the chain of hour 720 is still open
    assert got == [(START, 2, 90.0), (START + dt.timedelta(hours=240), 2, 70.0)]


def test_equal_times_have_one_order(spark, tmp_path):
    write(spark, tmp_path, "a", [(1, 0, 5.0), (1, 1, 9.0), (1, 1, 7.0)], 1000)
    write(spark, tmp_path, "b", [(1, 2, 1.0), (2, 2, 3.0)], 2000)
    got = sorted((r.video, r["diff"]) for r in state.replay(spark, f"{tmp_path}/in", "*.parquet").collect())
    assert got == [(1, 2.0), (1, 2.0), (1, 8.0)]


def test_segments_over_batches_equal_those_of_the_whole(spark, tmp_path):
    scores = [90, 70, None, 61, 60, 10, 80, 80, 20, 20, 99, 99]
    rows = [(v, h, None if s is None else float(s - 40 * (v == 2 and h % 4 == 3))) for h, s in enumerate(scores) for v in (1, 2)] + [(3, 0, 5.0)]
    rows = [(i, *r) for i, r in enumerate(rows)]
    for k, part in enumerate([rows[:9], rows[9:13], rows[13:]]):
        made = [(i, v, START + dt.timedelta(hours=h), s) for i, v, h, s in part]
        spark.createDataFrame(made, "event_id long, user_id long, ts timestamp, value double").coalesce(1).write.parquet(f"{tmp_path}/raw-{k}")
        name = next(f for f in os.listdir(f"{tmp_path}/raw-{k}") if f.endswith(".parquet"))
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        os.rename(f"{tmp_path}/raw-{k}/{name}", f"{tmp_path}/in/{k}.parquet")
        os.utime(f"{tmp_path}/in/{k}.parquet", (1000 * (k + 1),) * 2)
    hour = 3_600_000_000
    begin = int((START - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    whole = spark.createDataFrame([(i, v, begin + h * hour, s) for i, v, h, s in rows], "event_id long, video long, us long, score double")
    got = sorted(map(tuple, segments.replay(spark, f"{tmp_path}/in", "*.parquet", 60.0, hour, files_at_once=1).collect()))
    assert got == sorted(map(tuple, timeseries.segments(whole, 60.0, hour).collect())) and len(got) > 5
