"""Operators on frames: rows of a video, a time and a flat array of grey pixels (0-255)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import mean_difference


def brightness(pixels: Column) -> Column:
    """Mean of the pixels; null for an empty frame."""
    return F.try_divide(F.aggregate(pixels, F.lit(0.0), lambda s, x: s + x.cast("double")), F.size(pixels))


def share_above(pixels: Column, level: float) -> Column:
    return F.try_divide(F.size(F.filter(pixels, lambda x: x > level)).cast("double"), F.size(pixels))


def motion_score(frames: DataFrame, key: str = "video", t: str = "us", pixels: str = "pixels", tie: str = "event_id") -> DataFrame:
    """``key, motion``: mean absolute difference of neighbouring frames over 255; 0 with fewer than two frames."""
    before = F.lag(pixels).over(Window.partitionBy(key).orderBy(t, tie))
    steps = frames.withColumn("__before", before).select(key, mean_difference(F.col(pixels), F.col("__before"), 255.0).alias("__d"))
    return steps.groupBy(key).agg(F.coalesce(F.avg("__d"), F.lit(0.0)).alias("motion"))


def deviation(frames: DataFrame, query: DataFrame, pixels: str = "pixels") -> DataFrame:
    """``frames`` and ``deviation`` from the one frame of ``query`` (mean absolute pixel difference)."""
    return frames.crossJoin(F.broadcast(query.select(F.col(pixels).alias("__q")).limit(1))).withColumn("deviation", mean_difference(F.col(pixels), F.col("__q"))).drop("__q")


def without_background(pixels: Column, background: Column) -> Column:
    """Pixels less the background, around 128, cut to 0-255 and to whole numbers."""
    return F.zip_with(pixels, background, lambda x, b: F.greatest(F.lit(0), F.least(F.lit(255), x - b + 128)).cast("int"))


def runs(frames: DataFrame, level: float, pixels: str = "pixels") -> DataFrame:
    """``frames`` without their pixels and a row per unbroken run of pixels above ``level``: ``first, last`` places."""
    places = F.when(F.size(pixels) > 0, F.sequence(F.lit(0), F.size(pixels) - 1)).otherwise(F.array().cast("array<int>"))
    up = lambda i: F.coalesce(F.get(F.col(pixels), i) > level, F.lit(False))
    firsts = F.filter(places, lambda i: up(i) & ((i == 0) | ~up(i - 1)))
    lasts = F.filter(places, lambda i: up(i) & ~up(i + 1))
    found = F.inline(F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("first"), b.alias("last"))))
    return frames.select(*(c for c in frames.columns if c != pixels), found)
