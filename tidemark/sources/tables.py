"""Readers: tables by directory, the score samples held in the ``events`` table, listings, event logs."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a hand-logged event file; all are strings, any may be missing.
EVENT_LOG = "Date string, Time string, Event string, Details string, Cameras string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers find this package where the driver did, if it lies there on their machine too
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def followed(spark: SparkSession, folder: str, pattern: str, files_at_once: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What is there of a table, and a stream of it. ``pattern`` names its files, or folders of them, in ``folder``: a table may be
    one file or a folder of parts."""
    path = f"{folder}/{{{pattern}}}"  # a stream takes one file by a pattern only
    held = spark.read.parquet(path)
    reader = spark.readStream.schema(held.schema)
    return held, (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).parquet(path)


def micros(ts: str) -> Column:
    """Whole microseconds since 1970 of a timestamp's own wall clock, whatever the session's time zone."""
    return F.expr(f"datediff(CAST({ts} AS DATE), DATE'1970-01-01') * 86400000000L + hour({ts}) * 3600000000L + minute({ts}) * 60000000L + CAST(extract(SECOND FROM {ts}) * 1000000 AS BIGINT)")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, video, camera, us, score``: the events as one score sample each."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("video"), F.col("event_type").alias("camera"), micros("ts").alias("us"), F.col("value").alias("score"))


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of hand-logged events with a header; missing columns and fields read as empty strings."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    wanted = [c.split()[0] for c in EVENT_LOG.split(", ")]
    return raw.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) if c in raw.columns else F.lit("").alias(c) for c in wanted))


def json_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of objects under an explicit schema; absent keys are null."""
    return spark.read.schema(schema).json(path, multiLine=True)


def features(spark: SparkSession, path: str) -> DataFrame:
    """All feature files of a folder, with the file's stem as ``video_id``."""
    return spark.read.parquet(path).withColumn("video_id", F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1))


def hrefs(pages: DataFrame, pattern: str = 'href="([^"]+)"', html: str = "html") -> DataFrame:
    """``pages`` and a row per link, in page order: ``pos, href``."""
    return pages.select(*(c for c in pages.columns if c != html), F.posexplode(F.regexp_extract_all(html, F.lit(pattern), 1)).alias("pos", "href"))


def videos(listings: DataFrame, html: str = "html") -> DataFrame:
    """The videos that directory listings link, in page order. A listing that failed (null) has none."""
    return hrefs(listings, r'href="([^"]+\.mp4)"', html)


def files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """``path, name, length`` of a folder's files that match a glob, in order of their names; contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "length").orderBy("path")


def bundles(spark: SparkSession, folder: str, schema: str, pattern: str = "*.npz") -> DataFrame:
    """Rows of numpy bundles (one array per column, equally long) and the file's stem as ``video_id``."""
    import io

    import numpy as np
    import pandas as pd

    names = [c.split()[0] for c in schema.split(",")]

    def load(batches):
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    yield pd.DataFrame({n: list(z[n]) for n in names} | {"video_id": path.rsplit("/", 1)[-1].rsplit(".", 1)[0]})

    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content").mapInPandas(load, f"{schema}, video_id string")
