"""Scoring a stream in batches of exactly so many frames a camera, the remainder carried on.

Frames wait in keyed state until the watermark has passed them and join their camera's open batch in the order of time and
id. A batch is scored when it is full; what is left over stays in state for the next micro-batch, or a restarted query. After
``idle`` without frames a camera's remainder is scored as it is, and its state goes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.shared import fresh_path
from ..sources.tables import followed
from .foreground import ROCKSDB
from .scoring import attempt
from .waiting import Waiting

ROWS = "camera string, us long, event_id long, scored double, error string, batch_rows int"
#: Result rows that are handed on together.
TOGETHER = 1 << 14
Score = Callable[[list[float]], list[float]]


class Batcher(StatefulProcessor):
    def __init__(self, score: Score, size: int, idle: int):
        self.score, self.size, self.idle = score, size, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.arrived = Waiting(handle, "arrived", ("us", "event_id", "value"))
        self.open = Waiting(handle, "open", ("us", "event_id", "value"))
        self.last = handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = latest = None
        for part in rows:
            if len(part):
                self.arrived.add(self.arrived.made([part]))
                low, high = int(part["us"].min()), int(part["us"].max())
                first, latest = (low, high) if first is None else (min(first, low), max(latest, high))
        if first is not None:
            latest = max(latest, self.last.get()[0]) if self.last.exists() else latest
            self.last.update((latest,))
            self.handle.registerTimer(first // 1000)
            self.handle.registerTimer((latest + self.idle) // 1000 + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        opened = self.open.all()
        due, late = self.arrived.due(passed)
        rows = np.concatenate([opened, due])
        full = len(rows) // self.size * self.size
        over = late is None and self.last.exists() and (self.last.get()[0] + self.idle) // 1000 < passed
        step = max(1, TOGETHER // self.size) * self.size
        for lo in range(0, full, step):
            yield self._scored(key, rows[lo : min(full, lo + step)])
        rest = rows[full:]
        if over:
            if len(rest):
                yield self._scored(key, rest)
            self.open.put(rest[:0], len(opened))
            self.last.clear()
            return
        if late is not None:
            self.handle.registerTimer(late // 1000)
        if len(due):
            self.open.put(rest, len(opened))

    def _scored(self, key: tuple, rows: np.ndarray) -> pd.DataFrame:
        """Whole batches, or a last one of fewer rows."""
        values = [None if v != v else v for v in rows["value"].tolist()]
        done = [attempt(self.score, values[lo : lo + self.size]) for lo in range(0, len(values), self.size)]
        scores, errors = [s for d in done for s in d[0]], [e for d in done for e in d[1]]
        return pd.DataFrame({"camera": key[0], "us": rows["us"], "event_id": rows["event_id"], "scored": scores, "error": errors, "batch_rows": min(self.size, len(rows))})


def in_batches(frames: DataFrame, score: Score, size: int, delay: str, idle: int) -> DataFrame:
    """``camera, us, event_id, scored, error, batch_rows`` of streamed ``camera, ts, us, event_id, value``; ``idle`` in microseconds."""
    return frames.withWatermark("ts", delay).groupBy("camera").transformWithStateInPandas(Batcher(score, size, idle), ROWS, "Append", "EventTime")


def run(frames: DataFrame, score: Score, folder: str, size: int = 64, delay: str = "10 seconds", idle: int = 60_000_000) -> None:
    """Scores what the stream holds now; rows go to ``folder``/rows and its progress to ``folder``/state."""
    spark = frames.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        q = in_batches(frames, score, size, delay, idle).writeStream.option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows").format("parquet").trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    q.awaitTermination()


def replay(spark: SparkSession, folder: str, pattern: str, score: Score, size: int = 64) -> DataFrame:
    """Every camera's samples that are there, scored in batches. A row a year later, which the result leaves out, ends all cameras."""
    files, raw = followed(spark, folder, pattern)
    at = F.col("ts").cast("timestamp")
    made = raw.select(F.col("event_type").alias("camera"), at.alias("ts"), F.unix_micros(at).alias("us"), F.col("event_id").cast("long").alias("event_id"), F.col("value").cast("double").alias("value"))
    end = fresh_path(spark, "end-of-stream")
    closing = files.agg((F.max(at) + F.expr("INTERVAL 365 DAYS")).cast("timestamp").alias("ts"))
    closing.select(F.lit("").alias("camera"), "ts", F.unix_micros("ts").alias("us"), F.lit(-1).cast("long").alias("event_id"), F.lit(0.0).alias("value")).write.parquet(end)
    out = fresh_path(spark, "batches")
    run(made.unionByName(spark.readStream.schema(made.schema).parquet(end)), score, out, size, "0 seconds", 1)
    return spark.read.schema(ROWS).parquet(f"{out}/rows").where("camera <> ''")
