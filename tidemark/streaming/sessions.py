"""Peak chains over a stream: the batch operator's groups by session windows behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import fresh_path
from ..sources.tables import followed


def peak_sessions(samples: DataFrame, threshold: float, gap: str, late: str = "1 day") -> DataFrame:
    """``video, start, n, top``: chains of samples at or above the threshold no more than ``gap`` apart, given
    out when the watermark has passed them. Needs ``video, ts timestamp, score``."""
    up = samples.where(F.col("score") >= threshold).withWatermark("ts", late)
    return up.groupBy("video", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("score").alias("top")).select("video", F.col("w.start").alias("start"), "n", "top")


def stream(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """A stream of the samples in those files of a folder that match ``pattern``."""
    _, raw = followed(spark, folder, pattern)
    return raw.select(F.col("user_id").alias("video"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("score"))


def replay(spark: SparkSession, source: str, pattern: str, threshold: float, gap: str) -> DataFrame:
    """Runs the stream over all files that are there, in complete mode (so no chain waits for a watermark),
    and returns its result as a table in the shared folder."""
    folder = fresh_path(spark, "sessions")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    run = peak_sessions(stream(spark, source, pattern), threshold, gap).writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("video", "n", "top")
