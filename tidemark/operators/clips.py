"""From events to clips: scan windows, lead-ins, cut manifests and the index of what became of every event."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scan_window(offset: Column, duration: Column, reach: int) -> tuple[Column, Column]:
    """Start and end of the window around an offset, kept within the recording."""
    return F.greatest(F.lit(0).cast("long"), offset - reach), F.least(duration, offset + reach)


def lead_in(start: Column, lead: int, lowest: Column | None = None) -> Column:
    """A clip's start ``lead`` before its best window, from ``lowest`` (0) at least."""
    return F.greatest(F.lit(0).cast("long") if lowest is None else lowest, start - lead)


def cut_manifest(clips: DataFrame, existing: DataFrame, least_bytes: int = 10_000, recoded: Sequence[str] = (), camera: str = "camera", out: str = "out") -> DataFrame:
    """``clips`` that are still to be cut, with the audio ``codec``: those whose output isn't there or is too small.

    ``existing`` lists ``out, length``. Cutting itself is the caller's: one row is one call.
    """
    done = existing.where(F.col("length") > least_bytes).select(out).distinct()
    codec = F.when(F.col(camera).isin(*recoded), "aac").otherwise("copy") if recoded else F.lit("copy")
    return clips.join(done, out, "left_anti").select(*clips.columns, codec.alias("codec"))


def votes_with_markers(found: DataFrame, groups: DataFrame, group: Sequence[str], camera: str, least: int) -> DataFrame:
    """Every group with ``n_cameras`` and ``status``: confirmed, or negative where fewer cameras found something.
    A negative row keeps the next run from scanning the group again."""
    n = found.groupBy(*group).agg(F.countDistinct(camera).alias("n_cameras"))
    out = groups.select(*group).distinct().join(n, list(group), "left").withColumn("n_cameras", F.coalesce("n_cameras", F.lit(0).cast("long")))
    return out.withColumn("status", F.when(F.col("n_cameras") >= least, "confirmed").otherwise("negative"))


def clip_index(events: DataFrame, scores: DataFrame, reach: int, length: int, lead: int, warm_up: int, dark: str = "dark", event: str = "event_id", key: str = "video") -> DataFrame:
    """What became of every event: ``event, status, skip_reason, clip_start``.

    ``events`` has ``event, key, note, start, offset, duration``: the note of an unreadable time, the recording found
    (null if none) and the event's place in it. ``scores`` has ``key, us, score, dark``. Reasons are tried in order:
    the note, no recording, no scores in the window, only dark ones. Else the best window of ``length`` within the
    scan window gives the clip, ``lead`` earlier: scores of dark samples and of the first ``warm_up`` count as 0. Rows of one event's
    window are few (a window of samples), and the join is an equality on key and stretch of time.
    """
    lo, hi = scan_window(F.col("offset"), F.col("duration"), reach)
    asked = events.withColumns({"__lo": F.col("start") + lo, "__hi": F.col("start") + hi})
    stretch = lambda c: F.floor(c / (2 * reach))
    near = asked.where("note IS NULL AND start IS NOT NULL").select(event, key, "__lo", "__hi", F.explode(F.sequence(stretch(F.col("__lo")), stretch(F.col("__hi")))).alias("__s"))
    met = near.join(scores.select(key, F.col("us"), "score", F.col(dark).alias("__dark"), stretch(F.col("us")).alias("__s")), [key, "__s"]).where(F.col("us").between(F.col("__lo"), F.col("__hi")))
    heard = F.when(F.col("__dark") | (F.col("us") < F.col("__lo") + warm_up), 0.0).otherwise(F.col("score"))
    from pyspark.sql import Window

    w = Window.partitionBy(event).orderBy("us").rangeBetween(0, length - 1)
    summed = met.select(event, "us", "__lo", "__dark", F.sum(heard.cast("decimal(20,4)")).over(w).alias("__sum"))
    best = summed.groupBy(event).agg(F.max_by("us", F.struct(F.col("__sum"), -F.col("us"))).alias("__best"), F.bool_and("__dark").alias("__all_dark"), F.min("__lo").alias("__from"))
    done = asked.join(best, event, "left")
    reason = F.coalesce(F.col("note"), F.when(F.col("start").isNull(), "no_segment_on_server"), F.when(F.col("__best").isNull(), "no_scores"), F.when(F.col("__all_dark"), "no_bright_frames"))
    done = done.withColumn("skip_reason", reason)
    return done.select(event, F.when(F.col("skip_reason").isNull(), "extracted").otherwise("skipped").alias("status"), "skip_reason", F.when(F.col("skip_reason").isNull(), lead_in(F.col("__best"), lead, F.col("__from"))).alias("clip_start"))
