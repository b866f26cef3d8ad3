"""Scoring a stream of several cameras in small batches, where a failing row doesn't fail the others."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import fresh_path
from ..sources.tables import followed


def attempt(score: Callable[[list[float]], list[float]], values: list) -> tuple[list, list]:
    """Scores and errors of one batch. Where ``score`` raises, the values are scored one by one."""
    try:
        return score(values), [None] * len(values)
    except Exception as e:  # the scorer's own failures are rows of the result
        if len(values) == 1:
            return [None], [f"{type(e).__name__}: {e}"]
        parts = [attempt(score, [v]) for v in values]
        return [p[0][0] for p in parts], [p[1][0] for p in parts]


def scored(rows: DataFrame, score: Callable[[list[float]], list[float]], value: str = "score", size: int = 64) -> DataFrame:
    """``rows`` with ``scored`` and ``error``. ``score`` gets up to ``size`` values, the last batch what remains.
    Where it raises, its values are scored one by one; those that fail alone get the error's text and no score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(b.schema.get_field_index(value)).to_pylist()
            done = [attempt(score, values[k : k + size]) for k in range(0, len(values), size)]
            extra = [pa.array([x for s, _ in done for x in s], pa.float64()), pa.array([x for _, e in done for x in e], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, "scored", "error"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, scored double, error string")


def replay_cameras(spark: SparkSession, folder: str, pattern: str, cameras: list[str], score: Callable[[list[float]], list[float]]) -> DataFrame:
    """A stream per camera, together scored and appended batch by batch; a run that stops goes on at its checkpoint.
    Cameras without samples are absent."""
    streams = [followed(spark, folder, pattern)[1].where(F.col("event_type") == c).select("event_id", F.lit(c).alias("camera"), F.col("value").alias("score")) for c in cameras]
    together = streams[0]
    for s in streams[1:]:
        together = together.union(s)
    out = fresh_path(spark, "cameras")
    run = scored(together, score).writeStream.option("checkpointLocation", f"{out}/state").option("path", f"{out}/rows").format("parquet").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("event_id long, camera string, score double, scored double, error string").parquet(f"{out}/rows")
