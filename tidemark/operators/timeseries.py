"""Operators on time-stamped score series: rows of a key, whole microseconds and a score.

Every order has a unique last column (``tie``), so results don't depend on partitioning. Null scores are
below any threshold. What reads samples cuts long recordings by time (``buckets``); chains and slots, which see peaks, are one
shuffle by their key, and the aggregations that follow reuse it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .buckets import SECOND, best_window, interpolate, lag_difference, nearest, peaks, scaled_to_max, segments, smoothed, suppress, sweep

__all__ = ["SECOND", "best_window", "chains", "early_stop", "interpolate", "lag_difference", "merge_peaks", "nearest", "peaks", "scaled_to_max", "segments", "smoothed", "suppress", "sweep"]


def _ordered(key: Sequence[str], t: str, tie: str):
    return Window.partitionBy(*key).orderBy(t, tie)


def chains(df: DataFrame, gap: int, key: Sequence[str], t: str, tie: str) -> DataFrame:
    """``df`` and ``chain``: rows no more than ``gap`` after the row before them share one."""
    w = _ordered(key, t, tie)
    new = F.coalesce(F.col(t) - F.lag(t).over(w) > gap, F.lit(True))
    return df.withColumn("__new", new.cast("long")).withColumn("chain", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def merge_peaks(found: DataFrame, gap: int, pad: int, key: Sequence[str] = ("video",), t: str = "peak_us", tie: Sequence[str] | str = "camera") -> DataFrame:
    """``key, start_us, end_us, n``: chains of peaks of all cameras; each slot reaches ``pad`` to either side
    of its chain's mean time (in whole microseconds, towards 0), from 0 at least."""
    # times are summed as decimals: their sum may pass a long, and their quotient as doubles loses microseconds
    mean = F.call_function("div", F.sum(F.col(t).cast("decimal(20,0)")), F.count("*").cast("decimal(20,0)"))
    out = chains(found, gap, key, t, tie).groupBy(*key, "chain").agg(mean.alias("__m"), F.count("*").alias("n"))
    return out.select(*key, F.greatest(F.lit(0).cast("long"), F.col("__m") - pad).alias("start_us"), (F.col("__m") + pad).alias("end_us"), "n")


def early_stop(df: DataFrame, target: int, order: Sequence[str], confirmed: str) -> DataFrame:
    """Rows in ``order`` (unique) up to that with which ``target`` are confirmed; all if there are fewer.

    A row that confirms adds one at least, so the last row is among the first ``target`` of them: a distributed
    top list of that length finds it, and no running sum over all rows is needed.
    """
    at, n = F.struct(*order), F.col(confirmed).cast("long")
    first = df.where(n > 0).select(at.alias("__at"), n.alias("__n")).orderBy("__at").limit(target)
    summed = first.withColumn("__sum", F.sum("__n").over(Window.orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)))  # target rows at most
    last = summed.where(F.col("__sum") >= target).agg(F.min("__at").alias("__last"))
    return df.withColumn("__last", last.scalar()).where(F.col("__last").isNull() | (at <= F.col("__last"))).drop("__last")
