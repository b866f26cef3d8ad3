"""State carried per key over a stream: the difference to the sample before."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import fresh_path
from .sessions import stream


def lag_differences(samples: DataFrame) -> DataFrame:
    """``video, us, diff``: absolute difference of each sample to the one before it of its video. Files are
    expected in time order; within a micro-batch rows are sorted by time and score. State: one number a video."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["ts", "score"])
        before = state.get[0] if state.exists else None
        score = rows["score"].astype(float)
        diff = (score - score.shift(1, fill_value=float("nan") if before is None else before)).abs()
        state.update((float(score.iloc[-1]),))
        yield pd.DataFrame({"video": rows["video"], "ts": rows["ts"], "diff": diff}).dropna()

    return samples.groupBy("video").applyInPandasWithState(step, "video long, ts timestamp, diff double", "score double", "append", GroupStateTimeout.NoTimeout)


def replay(spark: SparkSession, source: str, pattern: str) -> DataFrame:
    """Runs the stream over the files that are there and returns what it gave out."""
    folder = fresh_path(spark, "state")
    run = lag_differences(stream(spark, source, pattern)).writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").format("parquet").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("video long, ts timestamp, diff double").parquet(f"{folder}/out")
