"""The foreground of cameras over a stream of frames: the batch operator's results, released behind the watermark.

Frames wait in keyed state until the watermark has passed them, so files may come in any order within ``delay``; later
frames, and those at or before 1970, where the watermark begins, are dropped by Spark and show in the query's progress. A camera's state is its model, the frames that wait (as many as
it has within the delay) and nothing else; a timer drops the model of a camera that was idle for longer than
``settings.idle``, which is when the batch operator begins a new one too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.foreground import RESULT, Mixture, Scene, Settings
from ..sources.shared import fresh_path
from ..sources.tables import followed

ROWS = f"video long, us long, event_id long, {RESULT}"
#: Result rows that are handed on together.
TOGETHER = 256
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Watcher(StatefulProcessor):
    def __init__(self, settings: Settings):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.model = handle.getValueState("model", "held binary, seen long, last long")
        self.waiting = handle.getMapState("waiting", "us long, event_id long", "pixels array<int>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for part in rows:
            for us, event_id, pixels in zip(part["us"], part["event_id"], part["pixels"], strict=True):
                self.waiting.updateValue((int(us), int(event_id)), (None if pixels is None else [int(p) for p in pixels],))
                first = int(us) if first is None else min(first, int(us))
        if first is not None:
            self.handle.registerTimer(first // 1000)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        scene = Scene(self.settings)
        if self.model.exists():
            held, seen, scene.last = self.model.get()
            scene.model = Mixture.from_bytes(self.settings, held, seen) if held else None
        waits = sorted(self.waiting.keys())
        due = [k for k in waits if k[0] // 1000 <= passed]
        if len(due) < len(waits):
            self.handle.registerTimer(waits[len(due)][0] // 1000)
        found = []
        for us, event_id in due:
            (pixels,) = self.waiting.getValue((us, event_id))
            self.waiting.removeKey((us, event_id))
            found.append((*key, us, event_id, *scene.frame(us, pixels)))
            if len(found) == TOGETHER:
                yield self._table(found)
                found = []
        if found:
            yield self._table(found)
        idle = self.settings.idle
        if idle is not None and scene.last is not None and (scene.last + idle) // 1000 < passed:
            self.model.clear()
        elif due:
            self.model.update((scene.model.to_bytes() if scene.model else None, scene.model.seen if scene.model else 0, scene.last))
            if idle is not None:
                self.handle.registerTimer((scene.last + idle) // 1000 + 1)

    def _table(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in ROWS.split(", ")])


def watched(frames: DataFrame, settings: Settings, delay: str = "10 seconds") -> DataFrame:
    """``video, us, event_id`` and the results, of a stream of ``video, ts`` (its event time), ``us, event_id, pixels``. The session's
    state store must be RocksDB's."""
    late = frames.withWatermark("ts", delay)
    return late.groupBy("video").transformWithStateInPandas(Watcher(settings), ROWS, "Append", "EventTime")


def run(frames: DataFrame, settings: Settings, folder: str, delay: str = "10 seconds") -> None:
    """Watches what the stream holds now; rows go to ``folder``/rows and its progress to ``folder``/state."""
    spark = frames.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        q = watched(frames, settings, delay).writeStream.option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows").format("parquet").trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    q.awaitTermination()


def replay(spark: SparkSession, folder: str, pattern: str, settings: Settings) -> DataFrame:
    """Runs over the vectors that are there, as tiny frames a second apart, and returns what was released. All files are one micro-batch:
    a table's files have no order of time, so frames of a later batch would be late."""
    _, raw = followed(spark, folder, pattern)
    grey = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 255).cast("int"))
    frames = raw.select(F.col("label").cast("long").alias("video"), F.timestamp_seconds(F.col("vec_id") + 1).alias("ts"), ((F.col("vec_id") + 1) * 1_000_000).alias("us"), F.col("vec_id").alias("event_id"), grey.alias("pixels"))
    out = fresh_path(spark, "foreground")
    run(frames, settings, out, "0 seconds")
    return spark.read.schema(ROWS).parquet(f"{out}/rows")
