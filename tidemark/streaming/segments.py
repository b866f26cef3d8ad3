"""Stretches above a threshold over a stream: the batch operator's segments, row by row as samples come."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import fresh_path
from ..sources.tables import followed, micros

ROWS = "video long, island long, start_us long, end_us long, n long, closed boolean"


def open_segments(samples: DataFrame, threshold: float, open_end: int = 1_000_000) -> DataFrame:
    """``video, island, start_us, end_us, n, closed`` of a stream of ``video, us, event_id, score``.

    A segment has a row in every micro-batch that adds to it; it ends ``open_end`` after its last sample until a sample
    below the threshold closes it. Files are expected in time order; within a micro-batch rows are sorted by time and id, and a
    video's rows of one micro-batch are one frame (bound the batches). Null scores are below. State: four numbers a video.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["us", "event_id"])
        island, start, n, last = state.get if state.exists else (0, 0, 0, 0)
        at, up = rows["us"].to_numpy(np.int64), rows["score"].to_numpy(np.float64, na_value=np.nan) >= threshold
        flips = np.flatnonzero(np.r_[n > 0, up[:-1]] != up).tolist()
        found = []
        for lo, hi in pairwise([*([] if flips[:1] == [0] else [0]), *flips, len(up)]):
            if up[lo]:
                if n == 0:
                    island, start = island + 1, int(at[lo])
                n, last = n + hi - lo, int(at[hi - 1])
            elif n:
                found.append((*key, island, start, int(at[lo]), n, True))
                n = 0
        if n:
            found.append((*key, island, start, last + open_end, n, False))
        state.update((island, start, n, last))
        if found:
            yield pd.DataFrame(found, columns=[c.split()[0] for c in ROWS.split(", ")])

    return samples.groupBy("video").applyInPandasWithState(step, ROWS, "island long, start long, n long, last long", "append", GroupStateTimeout.NoTimeout)


def latest(rows: DataFrame, least: int) -> DataFrame:
    """``video, start_us, end_us, n``: of each segment what was known last, without those shorter than ``least``."""
    last = F.max_by(F.struct("start_us", "end_us", "n"), F.struct("closed", "n"))
    return rows.groupBy("video", "island").agg(last.alias("s")).select("video", "s.*").where(F.col("end_us") - F.col("start_us") >= least)


def replay(spark: SparkSession, folder: str, pattern: str, threshold: float, least: int, files_at_once: int | None = None) -> DataFrame:
    """Runs the stream over the files that are there, so many at a time (all if not given; else they must be in time order), and returns the segments known at its end."""
    _, raw = followed(spark, folder, pattern, files_at_once)
    samples = raw.select(F.col("user_id").alias("video"), micros("ts").alias("us"), "event_id", F.col("value").alias("score"))
    out = fresh_path(spark, "segments")
    run = open_segments(samples, threshold).writeStream.option("checkpointLocation", f"{out}/state").option("path", f"{out}/rows").format("parquet").trigger(availableNow=True).start()
    run.awaitTermination()
    return latest(spark.read.schema(ROWS).parquet(f"{out}/rows"), least)
