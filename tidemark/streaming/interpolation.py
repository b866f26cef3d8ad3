"""Two series merged in order over a stream: rows of one with the other's value at their times, linear between its knots.

Both kinds of rows wait in keyed state until the watermark has passed them and are then taken in the order of the batch operator
(time, knots first, tie). A row's value is known once the next knot is: rows wait for it, and knots are forgotten as
soon as both neighbours are settled. After ``idle`` without rows the recording is over: what waits gets the last knot's value,
as in the batch, and the state goes. Every row is given out once; rows later than the watermark are dropped by Spark and
counted in the query's progress.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.shared import fresh_path
from ..sources.tables import followed
from .foreground import ROCKSDB
from .waiting import PIECE, Waiting

ROWS = "video long, us long, event_id long, interpolated double"


def between(at: np.ndarray, left_us: np.ndarray, left: np.ndarray, right_us: np.ndarray, right: np.ndarray, has_left: np.ndarray, has_right: np.ndarray) -> np.ndarray:
    """The values at times of neighbours (times and values): the end values beyond them, not a number without any."""
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = left + (right - left) * (at - left_us) / (right_us - left_us)
    return np.where(~has_left, np.where(has_right, right, np.nan), np.where(~has_right | (left_us == at), left, inner))


class Merger(StatefulProcessor):
    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.arrived = Waiting(handle, "arrived", ("us", "is_row", "event_id", "value"))
        self.unsettled = Waiting(handle, "unsettled", ("us", "is_row", "event_id", "value"))
        self.about = handle.getValueState("about", "last long, known boolean, us long, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = [p for p in rows if len(p)]
        if parts:
            new = self.arrived.made(parts)
            self.arrived.add(new)
            last, *knot = self.about.get() or (None, False, None, None)
            last = int(new["us"].max()) if last is None else max(last, int(new["us"].max()))
            self.about.update((last, *knot))
            self.handle.registerTimer(int(new["us"].min()) // 1000)
            self.handle.registerTimer((last + self.idle) // 1000 + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        about = self.about.get()
        if about is None:  # the recording is over
            return
        passed = timerValues.getCurrentWatermarkInMs()
        last, known, knot_us, knot = about
        waits = self.unsettled.all()
        due, late = self.arrived.due(passed)
        over = late is None and (last + self.idle) // 1000 < passed
        knots = due[due["is_row"] == 0]
        rows = np.concatenate([waits, due[due["is_row"] == 1]])
        # the knots before each row, of those that came now: rows that waited come before them all
        before = np.concatenate([np.zeros(len(waits), np.int64), np.cumsum(due["is_row"] == 0)[due["is_row"] == 1]])
        times = np.concatenate([[knot_us] if known else np.zeros(0, np.int64), knots["us"], [0]]).astype(np.int64)
        values = np.concatenate([[np.nan if knot is None else knot] if known else np.zeros(0), knots["value"], [np.nan]])
        n, left = len(times) - 1, before + bool(known) - 1
        settled = (left + 1 < n) | over
        us, at = rows["us"][settled], left[settled]
        # place n stands for none, as does -1
        found = between(us, times[at], values[at], times[at + 1], values[at + 1], at >= 0, at + 1 < n)
        if over:
            self.unsettled.put(rows[:0], len(waits))
            self.about.clear()
        else:
            if late is not None:
                self.handle.registerTimer(late // 1000)
            if len(knots):
                self.about.update((last, True, int(times[n - 1]), None if np.isnan(values[n - 1]) else float(values[n - 1])))
            if len(due):
                self.unsettled.put(rows[~settled], len(waits))
        for lo in range(0, len(us), PIECE):
            cut = slice(lo, lo + PIECE)
            yield pd.DataFrame({"video": key[0], "us": us[cut], "event_id": rows["event_id"][settled][cut], "interpolated": found[cut]})


def interpolated(rows: DataFrame, knots: DataFrame, delay: str, idle: int) -> DataFrame:
    """``video, us, event_id, interpolated`` of streamed ``rows`` (``video, ts, us, event_id``) at streamed ``knots`` (with ``value``
    too). ``idle`` is in microseconds."""
    both = rows.select("video", "ts", "us", "event_id", F.lit(1).alias("is_row"), F.lit(None).cast("double").alias("value"))
    both = both.unionByName(knots.select("video", "ts", "us", "event_id", F.lit(0).alias("is_row"), "value"))
    return both.withWatermark("ts", delay).groupBy("video").transformWithStateInPandas(Merger(idle), ROWS, "Append", "EventTime")


def run(rows: DataFrame, knots: DataFrame, folder: str, delay: str, idle: int):
    """Merges what the streams hold now; rows go to ``folder``/rows. Returns the finished query."""
    spark = rows.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        q = interpolated(rows, knots, delay, idle).writeStream.option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows").format("parquet").trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    q.awaitTermination()
    return q


def replay(spark: SparkSession, folder: str, pattern: str, rows: str, knots: str) -> DataFrame:
    """Events of one type with another's value at their times, over the files that are there. A stream ends nowhere, so what waits for
    a knot that never comes isn't given out: a closing file a year later, which the result leaves out, ends all recordings."""
    held, raw = followed(spark, folder, pattern)
    shape = "video long, ts timestamp, us long, event_id long, value double"
    end = fresh_path(spark, "end-of-stream")
    last = held.agg(F.max("ts").alias("ts"))
    closing = last.select(F.lit(-1).cast("long").alias("video"), (F.col("ts") + F.expr("INTERVAL 365 DAYS")).cast("timestamp").alias("ts"), F.lit(-1).cast("long").alias("event_id"), F.lit(0.0).alias("value"))
    closing.select("video", "ts", F.unix_micros("ts").alias("us"), "event_id", "value").write.parquet(end)
    made = raw.select(F.col("user_id").cast("long").alias("video"), F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").cast("long").alias("event_id"), F.col("value").cast("double").alias("value"), "event_type")
    closing_stream = spark.readStream.schema(shape).parquet(end)
    out = fresh_path(spark, "interpolated")
    run(made.where(F.col("event_type") == rows).drop("event_type"), made.where(F.col("event_type") == knots).drop("event_type").unionByName(closing_stream), out, "0 seconds", 1)
    return spark.read.schema(ROWS).parquet(f"{out}/rows").where("video >= 0")
