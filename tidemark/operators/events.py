"""Joining logged events to recordings, resuming, and matching cameras."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(events: DataFrame, recordings: DataFrame, length: int, middle: int, on: Sequence[str], event_id: str, at: str, start: str, order: Sequence[str]) -> DataFrame:
    """``events`` and the recording each lies in (``start``, ``offset`` and the ``order`` columns), null if
    none: those that start up to ``length`` before it count, both ends included. Of several that of the first
    rank wins (``order[0]``), then that whose middle is nearest, then the rest of ``order``.

    An equality on ``on`` is needed; every recording is cut into stretches of ``length`` so the join is an
    equality on key and stretch (two of them a recording), and a busy key is dealt out by time.
    """
    stretch = lambda c: F.floor(c / length)
    kept = recordings.select(*on, start, *order).withColumn("__s", F.explode(F.array(stretch(F.col(start)), stretch(F.col(start)) + 1)))
    met = events.withColumn("__s", stretch(F.col(at))).join(kept, [*on, "__s"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(start) + length))
    met = met.withColumn("offset", F.col(at) - F.col(start))
    choice = F.min(F.struct(F.col(order[0]), F.abs(F.col("offset") - middle).alias("__d"), *(F.col(c) for c in order[1:]), F.col(start), F.col("offset")))
    best = met.groupBy(event_id).agg(choice.alias("__b")).select(event_id, *(F.col(f"__b.{c}").alias(c) for c in (start, "offset", *order)))
    return events.join(best, event_id, "left")


def first_by(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row in ``order`` of each key, by partial minima (no sort of a key's rows)."""
    rest = [c for c in df.columns if c not in key and c not in order]
    best = df.groupBy(*key).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("__b"))
    return best.select(*key, *(F.col(f"__b.{c}").alias(c) for c in (*order, *rest))).select(*df.columns)


def resume(todo: DataFrame, done: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """What is to do: the first row of each key that ``done`` doesn't hold. A later row of the same key is
    left out even if its time differs."""
    return first_by(todo, key, order).join(done.select(*key).distinct(), list(key), "left_anti").select(todo.columns)


def upsert_ignore(stored: DataFrame, new: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``stored`` and those new rows whose key it lacks; of several the first in ``order``."""
    return stored.unionByName(first_by(new, [key], order).join(stored.select(key), key, "left_anti").select(stored.columns))


def update_status(stored: DataFrame, updates: DataFrame, key: str, columns: Sequence[str], keep_on_null: bool = False) -> DataFrame:
    """``stored`` with ``columns`` of the matching update, nulls too: an update without a path erases it. With
    ``keep_on_null`` a null keeps what is stored. Of several updates of a key the least in ``columns`` counts."""
    u = updates.groupBy(key).agg(F.min(F.struct(*columns)).alias("__u")).withColumn("__hit", F.lit(True))
    out = stored.join(u, key, "left")
    new = lambda c: F.coalesce(F.col(f"__u.{c}"), F.col(c)) if keep_on_null else F.when(F.col("__hit"), F.col(f"__u.{c}")).otherwise(F.col(c))
    return out.withColumns({c: new(c) for c in columns}).select(stored.columns)


def by_status(manifest: DataFrame, status: str, column: str = "status") -> DataFrame:
    """The rows of a status, as the next stage reads them."""
    return manifest.where(F.col(column) == status)


def reason(*cases: tuple[Column, str]) -> Column:
    """The first reason that holds, else null."""
    return F.coalesce(*(F.when(cond, F.lit(name)) for cond, name in cases))


def cameras_of_group(rows: DataFrame, group: Sequence[str], camera: str, item: str, order: Sequence[str]) -> DataFrame:
    """``group, camera, item``: each camera's first item of a group."""
    return rows.groupBy(*group, camera).agg(F.min_by(item, F.struct(*order)).alias(item))


def vote(found: DataFrame, group: Sequence[str], camera: str, least: int) -> DataFrame:
    """``group, n_cameras``: groups that at least ``least`` cameras have rows in."""
    return found.groupBy(*group).agg(F.countDistinct(camera).alias("n_cameras")).where(F.col("n_cameras") >= least)


def slices(df: DataFrame, duration: str, length: float, least: float, key: str) -> DataFrame:
    """``key, clip_id, start_sec, end_sec``: whole clips of ``length``; the tail is dropped, as are items
    shorter than ``least``."""
    n = F.floor(F.col(duration) / length)
    kept = df.where((F.col(duration) >= least) & (n > 0)).select(key, F.posexplode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("pos", "i"))
    return kept.select(key, F.format_string("%s_clip%04d", F.col(key).cast("string"), "i").alias("clip_id"), (F.col("i") * length).alias("start_sec"), ((F.col("i") + 1) * length).alias("end_sec"))


def top_per_group(df: DataFrame, n: int, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first ``n`` rows in ``order`` of each group with their ``place``."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
