"""Series operators that cut long recordings by time, so that one recording is the work of many tasks.

A key of more than ``rows`` samples is cut into buckets of equal duration that hold about so many; all other keys are one
bucket. Each bucket is summed up on its own: what lies wholly inside is final, what reaches its first or last
sample stays open. The open pieces (two a bucket at most) and the buckets' totals then meet in one window by key, which
sees buckets and not samples.

Which keys are cut, and how, comes from one count by key. Fewer than ``most_cut`` keys can hold more than that share of all samples
each, and only those are cut, so their list has a proven size and is broadcast.

Samples without a time don't count. Results don't depend on where recordings are cut, ties included.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize
from .joins import dealt_join

SECOND = 1_000_000
#: Samples of a bucket.
ROWS = 100_000
MOST_CUT = 50_000


def same_key(key: Sequence[str], prefix: str) -> Column:
    """Equal keys, null ones too, where the other side's columns are ``prefix`` and a number."""
    found = [F.col(k).eqNullSafe(F.col(f"{prefix}{i}")) for i, k in enumerate(key)]
    return reduce(lambda a, b: a & b, found)


def bucket_at(at: Column) -> Column:
    """The bucket of a time, for rows of ``cut``."""
    return F.coalesce(F.floor((at - F.col("__from")) / F.col("__width")), F.lit(0).cast("long"))


def cut(df: DataFrame, key: Sequence[str], t: str, rows: int = ROWS, most_cut: int = MOST_CUT) -> DataFrame:
    """``df`` (samples that have a time) and ``__b``, the number of the key's bucket: 0 for keys that aren't cut, which
    have no ``__from`` and ``__width``."""
    return _cut(df, key, t, rows, most_cut)[0]


def _cut(df: DataFrame, key: Sequence[str], t: str, rows: int, most_cut: int = MOST_CUT) -> tuple[DataFrame, bool]:
    """``cut``, and whether any key is."""
    df = df.where(F.col(t).isNotNull())
    by_key = df.groupBy(*key).agg(F.count("*").alias("__n"), F.min(t).alias("__from"), F.max(t).alias("__to"))
    total, most = by_key.agg(F.sum("__n"), F.max("__n")).first()
    least = max(rows, -(-(total or 0) // most_cut))
    if (most or 0) <= least:  # no key is long
        nothing = F.lit(None).cast("long")
        return df.select(*df.columns, nothing.alias("__from"), nothing.alias("__width"), F.lit(0).cast("long").alias("__b")), False
    width = F.greatest(F.lit(1).cast("long"), F.floor((F.col("__to") - F.col("__from")) * least / F.col("__n")))
    long_ones = by_key.where(F.col("__n") > least).select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(key)), "__from", width.alias("__width"))
    cut_up = df.join(F.broadcast(long_ones), same_key(key, "__k"), "left")  # fewer than most_cut rows
    return cut_up.select(*df.columns, "__from", "__width", bucket_at(F.col(t)).alias("__b")), True


def _inside(key: Sequence[str], *order: str):
    return Window.partitionBy(*key, "__b").orderBy(*order)


def segments(df: DataFrame, threshold: float, least: int, key: Sequence[str] = ("video",), t: str = "us", score: str = "score", tie: str = "event_id", open_end: int = SECOND, rows: int = ROWS) -> DataFrame:
    """``key, start_us, end_us, n``: stretches of samples at or above ``threshold``. One ends at the first
    sample below it, or ``open_end`` after the last sample; those shorter than ``least`` are dropped."""
    up = F.coalesce(F.col(score) >= threshold, F.lit(False))
    marked = cut(df.select(*key, F.col(t).alias("__t"), F.col(tie).alias("__tie"), up.alias("__f")), key, "__t", rows)
    w = _inside(key, "__t", "__tie")
    before = F.lag("__f").over(w)
    marked = marked.withColumns({"__before": before, "__next": F.lead("__t").over(w)})
    marked = marked.withColumn("__island", F.sum((F.col("__f") & ~F.coalesce("__before", F.lit(False))).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = marked.groupBy(*key, "__b", "__island", "__f").agg(
        F.min("__t").alias("start"), F.max("__t").alias("last"), F.count("*").alias("n"), F.max("__next").alias("next"),
        F.bool_or(F.col("__before").isNull()).alias("left"), F.bool_or(F.col("__next").isNull()).alias("right"),
    )
    inside = pieces.where("__f AND NOT left AND NOT right").select(*key, F.col("start").alias("start_us"), F.col("next").alias("end_us"), "n")
    piece = F.struct("start", "last", "n", "next", "left", "right")
    ends = pieces.groupBy(*key, "__b").agg(F.min("start").alias("first"), F.max(F.when(F.col("__f") & F.col("left"), piece)).alias("head"), F.max(F.when(F.col("__f") & F.col("right") & ~F.col("left"), piece)).alias("tail"))
    # a bucket whose first sample is below the threshold still stands between its neighbours, as an empty piece
    none = F.struct(*(F.lit(None).cast("long").alias(c) for c in ("start", "last", "n", "next")), F.lit(False).alias("left"), F.lit(False).alias("right"))
    both = F.filter(F.array(F.struct(F.lit(0).alias("side"), F.coalesce("head", none).alias("p")), F.struct(F.lit(1).alias("side"), F.col("tail").alias("p"))), lambda x: x["p"].isNotNull())
    opened = ends.select(*key, "__b", "first", F.explode(both).alias("e")).select(*key, "__b", "first", "e.side", "e.p.*")
    by = Window.partitionBy(*key).orderBy("__b", "side")
    opened = opened.withColumns({"__joins": F.col("left") & F.coalesce(F.lag("right").over(by), F.lit(False)), "__after": F.lead("first").over(by)})
    opened = opened.withColumn("__chain", F.sum((~F.col("__joins")).cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0))).where("start IS NOT NULL")
    end = F.when(F.col("right"), F.coalesce("__after", F.col("last") + open_end)).otherwise(F.col("next"))
    across = opened.groupBy(*key, "__chain").agg(F.min("start").alias("start_us"), F.max(end).alias("end_us"), F.sum("n").alias("n")).drop("__chain")
    return inside.unionByName(across).where(F.col("end_us") - F.col("start_us") >= least)


def peaks(df: DataFrame, threshold: float, gap: int, key: Sequence[str] = ("video",), t: str = "us", score: str = "score", tie: str = "event_id", rows: int = ROWS) -> DataFrame:
    """``key, peak_us, peak_score, n``: of each chain of samples at or above the threshold the first highest."""
    up = cut(df.where(F.col(score) >= threshold).select(*key, F.col(t).alias("__t"), F.col(score).alias("__s"), F.col(tie).alias("__tie")), key, "__t", rows)
    w = _inside(key, "__t", "__tie")
    up = up.withColumns({"__before": F.lag("__t").over(w), "__next": F.lead("__t").over(w)})
    up = up.withColumn("__chain", F.sum((F.col("__t") - F.col("__before") > gap).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.struct(F.col("__s"), -F.col("__t"))
    pieces = up.groupBy(*key, "__b", F.coalesce("__chain", F.lit(0).cast("long")).alias("__chain")).agg(
        F.min("__t").alias("start"), F.max("__t").alias("last"), F.count("*").alias("n"), F.max_by(F.struct(F.col("__t").alias("t"), F.col("__s").alias("s")), rank).alias("best"),
        F.bool_or(F.col("__before").isNull() | F.col("__next").isNull()).alias("open"),
    )
    inside = pieces.where("NOT open").select(*key, "best", "n")
    by = Window.partitionBy(*key).orderBy("__b", "start")
    opened = pieces.where("open").withColumn("__new", F.coalesce(F.col("start") - F.lag("last").over(by) > gap, F.lit(True)).cast("long"))
    opened = opened.withColumn("__chain", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    across = opened.groupBy(*key, "__chain").agg(F.max_by("best", F.struct(F.col("best.s"), -F.col("best.t"))).alias("best"), F.sum("n").alias("n")).drop("__chain")
    return inside.unionByName(across).select(*key, F.col("best.t").alias("peak_us"), F.col("best.s").alias("peak_score"), "n")


def best_window(df: DataFrame, length: int, key: Sequence[str] = ("video",), t: str = "us", score: str = "score", skip_zero: bool = False, rows: int = ROWS) -> DataFrame:
    """``key, start_us, total``: the sample from which the scores within ``length`` (its end excluded) sum
    highest, the first of equals. With ``skip_zero`` keys whose scores are all 0 have no row.

    A window's sum is a difference of two running sums, at its end and before its start. Each is a bucket's
    own running sum and the total of the buckets before, so no frame slides over samples.
    """
    exact = "decimal(30,4)"
    moments = cut(df.select(*key, F.col(t).alias("__t"), F.col(score).cast("decimal(20,4)").alias("__s")), key, "__t", rows)
    # all samples of a moment are one; windows without any score have no sum
    moments = moments.groupBy(*key, "__b", "__t", "__from", "__width").agg(F.coalesce(F.sum("__s"), F.lit(0)).cast(exact).alias("__s"), F.count("__s").alias("__n"))
    moments, _ = materialize(moments, "moments")
    starts = moments.select(*key, "__b", F.col("__t").alias("__of"), F.col("__t").alias("__at"), F.lit(0).alias("__end"), "__s", "__n")
    at = F.col("__t") + (length - 1)
    ends = moments.select(*key, bucket_at(at).alias("__b"), F.col("__t").alias("__of"), at.alias("__at"), F.lit(1).alias("__end"), F.lit(0).cast(exact).alias("__s"), F.lit(0).cast("long").alias("__n"))
    both = starts.unionByName(ends)
    earlier = Window.partitionBy(*key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = both.groupBy(*key, "__b").agg(F.sum("__s").cast(exact).alias("__s"), F.sum("__n").alias("__n"))
    before = totals.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(key)), F.col("__b").alias("__kb"), F.coalesce(F.sum("__s").over(earlier), F.lit(0)).cast(exact).alias("__base"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base_n"))
    w = _inside(key, "__at", "__end").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"__run": F.sum("__s").over(w).cast(exact), "__run_n": F.sum("__n").over(w)}).join(before, same_key(key, "__k") & (F.col("__b") == F.col("__kb")))
    through, through_n, is_end = F.col("__base") + F.col("__run"), F.col("__base_n") + F.col("__run_n"), F.col("__end") == 1
    total = F.sum(F.when(is_end, through).otherwise(F.col("__s") - through).cast(exact)).cast(exact)
    windows = both.groupBy(*key, F.col("__of").alias("t")).agg(total.alias("total"), F.sum(F.when(is_end, through_n).otherwise(F.col("__n") - through_n)).alias("__m"))
    windows = windows.withColumn("total", F.when(F.col("__m") > 0, F.col("total")))
    out = windows.groupBy(*key).agg(F.max_by(F.struct("t", "total"), F.struct("total", -F.col("t"))).alias("__w"))
    out = out.select(*key, F.col("__w.t").alias("start_us"), F.col("__w.total").cast("double").alias("total"))
    return out.where("total > 0") if skip_zero else out


def numbered(df: DataFrame, key: Sequence[str], t: str, tie: str, rows: int = ROWS) -> DataFrame:
    """``df`` and a sample's place in its key (``__i``, from 0) and how many its key has (``__of``)."""
    by = cut(df, key, t, rows).drop("__from", "__width")
    sizes = by.groupBy(*key, "__b").agg(F.count("*").alias("__n"))
    of_key = Window.partitionBy(*key)
    before = F.coalesce(F.sum("__n").over(of_key.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(key)), F.col("__b").alias("__kb"), before.alias("__base"), F.sum("__n").over(of_key).alias("__of"))
    placed = by.withColumn("__i", F.row_number().over(_inside(key, t, tie)) - 1)
    placed = placed.join(sizes, same_key(key, "__k") & (F.col("__b") == F.col("__kb")))
    return placed.select(*df.columns, (F.col("__base") + F.col("__i")).alias("__i"), "__of")


def smoothed(df: DataFrame, column: str, width: int, key: Sequence[str] = ("video",), t: str = "us", tie: str = "event_id", to: str = "smooth", rows: int = ROWS) -> DataFrame:
    """``df`` and the centred mean of ``width`` samples of ``column``, padded by zeros: the whole width divides, at the ends too.
    Series shorter than the width stay as they are. An even width reaches one row further back.

    Stretches of equally many samples are smoothed apart; those near a border go to both sides of it.
    """
    back, ahead, size = width // 2, width - 1 - width // 2, max(rows, width)
    placed = numbered(df, key, t, tie, rows)
    near = F.sequence(F.greatest(F.lit(0), F.floor((F.col("__i") - ahead) / size)).cast("long"), F.least(F.floor((F.col("__i") + back) / size), F.floor((F.col("__of") - 1) / size)).cast("long"))
    w = Window.partitionBy(*key, "__near").orderBy("__i").rowsBetween(-back, ahead)
    mean = F.when(F.col("__of") >= width, F.sum(column).over(w) / width).otherwise(F.col(column))
    spread = placed.withColumn("__near", F.explode(near)).withColumn(to, mean)
    return spread.where(F.col("__near") == F.floor(F.col("__i") / size)).select(*df.columns, to)


def lag_difference(df: DataFrame, key: Sequence[str] = ("video",), t: str = "us", score: str = "score", tie: str = "event_id", to: str = "diff", rows: int = ROWS) -> DataFrame:
    """Absolute difference to the sample before; the first of a key has no row."""
    by = cut(df, key, t, rows).drop("__from", "__width")
    last = by.groupBy(*key, "__b").agg(F.max_by(F.struct(F.col(score).alias("s")), F.struct(t, tie)).alias("__last"))
    last = last.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(key)), F.col("__b").alias("__kb"), F.lag("__last").over(Window.partitionBy(*key).orderBy("__b"))["s"].alias("__earlier"))
    w = _inside(key, t, tie)
    by = by.withColumns({"__first": F.row_number().over(w) == 1, "__before": F.lag(score).over(w)}).join(last, same_key(key, "__k") & (F.col("__b") == F.col("__kb")))
    before = F.when(F.col("__first"), F.col("__earlier")).otherwise(F.col("__before"))
    return by.withColumn(to, F.abs(F.col(score) - before)).where(F.col(to).isNotNull()).select(*df.columns, to)


def _between(samples: DataFrame, asked: DataFrame, key: Sequence[str], rows: int) -> DataFrame:
    """``asked`` (key, ``__t``, ``__ask``) and the ``__k`` of the samples (key, ``__t``, ``__tie``, ``__k``) around each: ``__l`` of
    the last at its time or before, ``__r`` of the first after it; null where there is none.

    Both are cut together. A bucket is sent the last sample before and the first after it, which come from the buckets' own ends,
    so one shuffle of rows does. Looking ahead is a running value over the opposite order: a frame that ends with its
    partition would be read again for every row.
    """
    kinds = {c: samples.schema[c].dataType for c in ("__tie", "__k")} | {"__ask": asked.schema["__ask"].dataType}
    both = samples.select(*key, "__t", "__tie", "__k", F.lit(0).alias("__q"), F.lit(None).cast(kinds["__ask"]).alias("__ask"))
    both = both.unionByName(asked.select(*key, "__t", F.lit(None).cast(kinds["__tie"]).alias("__tie"), F.lit(None).cast(kinds["__k"]).alias("__k"), F.lit(1).alias("__q"), "__ask"))
    both, is_cut = _cut(both, key, "__t", rows)
    both = both.drop("__from", "__width")
    if is_cut:
        sample = F.when(F.col("__q") == 0, F.struct("__t", "__tie", "__k"))
        ends = both.groupBy(*key, "__b").agg(F.min(sample).alias("__first"), F.max(sample).alias("__last"))
        by = Window.partitionBy(*key)
        # a running value in either direction, from the bucket beside this one on
        earlier = F.last("__last", ignorenulls=True).over(by.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
        later = F.last("__first", ignorenulls=True).over(by.orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1))
        ends = ends.withColumns({"__earlier": earlier, "__later": later})
        sent = ends.select(*key, "__b", F.explode(F.array("__earlier", "__later")).alias("__s")).where("__s IS NOT NULL")
        both = both.unionByName(sent.select(*key, "__b", "__s.*", F.lit(0).alias("__q"), F.lit(None).cast(kinds["__ask"]).alias("__ask")))
    running = (Window.unboundedPreceding, 0)
    w = _inside(key, "__t", "__q", "__tie").rowsBetween(*running)
    back = Window.partitionBy(*key, "__b").orderBy(F.desc("__t"), F.desc("__q"), F.desc("__tie")).rowsBetween(*running)
    around = both.withColumns({"__l": F.last("__k", ignorenulls=True).over(w), "__r": F.last("__k", ignorenulls=True).over(back)})
    return around.where("__q = 1").select(*key, "__t", "__ask", "__l", "__r")


def interpolate(queries: DataFrame, knots: DataFrame, key: Sequence[str] = ("video",), t: str = "us", tie: str = "event_id", value: str = "score", to: str = "interpolated", rows: int = ROWS) -> DataFrame:
    """``queries`` and the knots' value at their times: linear between neighbours, the end values beyond
    them, null for keys without knots and for queries without a time. No range join: both series meet in one ordered window."""
    samples = knots.select(*key, F.col(t).alias("__t"), F.col(tie).alias("__tie"), F.struct(F.col(t).alias("t"), F.col(value).alias("v")).alias("__k"))
    found = _between(samples, queries.select(*key, F.col(t).alias("__t"), F.struct(*queries.columns).alias("__ask")), key, rows)
    lo, hi = F.col("__l"), F.col("__r")
    line = lo["v"] + (hi["v"] - lo["v"]) * (F.col("__t") - lo["t"]) / (hi["t"] - lo["t"])
    found = found.select("__ask.*", F.when(lo.isNull(), hi["v"]).when(hi.isNull() | (lo["t"] == F.col("__t")), lo["v"]).otherwise(line).alias(to))
    return found.unionByName(queries.where(F.col(t).isNull()).withColumn(to, F.lit(None).cast(found.schema[to].dataType)))


def nearest(df: DataFrame, grid: DataFrame, reach: int, key: Sequence[str] = ("video",), t: str = "us", tie: str = "event_id", rows: int = ROWS) -> DataFrame:
    """``grid`` (key, ``at``) and the nearest sample's time within ``reach``, the earlier of two as near."""
    samples = df.select(*key, F.col(t).alias("__t"), F.col(tie).alias("__tie"), F.struct(F.col(t).alias("t")).alias("__k"))
    found = _between(samples, grid.select(*key, F.col("at").alias("__t"), F.struct(F.col("at")).alias("__ask")), key, rows)
    before, after = F.col("__l")["t"], F.col("__r")["t"]
    pick = F.when(after.isNull() | (F.col("__t") - before <= after - F.col("__t")), before).otherwise(after)
    return found.select(*key, "__ask.at", pick.alias("sample_us")).where(F.abs(F.col("sample_us") - F.col("at")) <= reach)


def scaled_to_max(df: DataFrame, column: str, key: Sequence[str] = ("video",)) -> DataFrame:
    """``df`` with ``column`` over its key's maximum, or as it is where that isn't above 0.

    Maxima are one aggregation; a long key's rows are dealt over tasks when they meet theirs.
    """
    whole = F.struct(*key)
    tops, _ = materialize(df.groupBy(whole.alias("__key")).agg(F.max(column).alias("__top"), F.count("*").alias("__n")), "maxima")
    total = tops.agg(F.sum("__n")).first()[0] or 0
    met = dealt_join(df.withColumn("__key", whole), tops, "__key", df.columns, "__n", total)
    return met.select(*(F.when(F.col("__top") > 0, F.col(c) / F.col("__top")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in df.columns))


def sweep(df: DataFrame, thresholds: Sequence[int], least: int, key: Sequence[str] = ("video",), t: str = "us", score: str = "score", tie: str = "event_id", open_end: int = SECOND, rows: int = ROWS) -> DataFrame:
    """``threshold, n_segments, kept_us``: what stays of the series at each threshold; none where nothing does.

    One sorted pass over each bucket numbers the stretches of all thresholds, and only samples above a threshold are counted
    for it. A stretch that reaches its bucket's first or last sample joins that of the bucket beside it.
    """
    marked = cut(df.select(*key, F.col(t).alias("__t"), F.col(score).alias("__s"), F.col(tie).alias("__tie")), key, "__t", rows)
    w = _inside(key, "__t", "__tie")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumns({"__before": F.lag("__s").over(w), "__next": F.lead("__t").over(w), "__i": F.row_number().over(w)})
    up = [F.coalesce(F.col("__s") >= x, F.lit(False)) for x in thresholds]
    new = [u & ~F.coalesce(F.col("__before") >= x, F.lit(False)) for u, x in zip(up, thresholds, strict=True)]
    marked = marked.withColumns({f"__n{k}": F.sum(n.cast("long")).over(so_far) for k, n in enumerate(new)})
    each = F.array(*(F.struct(F.lit(x).alias("threshold"), u.alias("up"), F.col(f"__n{k}").alias("island")) for k, (u, x) in enumerate(zip(up, thresholds, strict=True))))
    counted = marked.select(*key, "__b", "__t", "__next", "__i", F.explode(F.filter(each, lambda e: e["up"])).alias("__e"))
    pieces = counted.groupBy(*key, "__b", F.col("__e.threshold").alias("threshold"), F.col("__e.island").alias("island")).agg(
        F.min("__t").alias("start"), F.max("__t").alias("last"), F.max("__next").alias("next"), (F.min("__i") == 1).alias("left"), F.bool_or(F.col("__next").isNull()).alias("right"),
    )
    inside = pieces.where("NOT left AND NOT right").select("threshold", (F.col("next") - F.col("start")).alias("__long"))
    places = marked.groupBy(*key, "__b").agg(F.min("__t").alias("__first")).select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(key)), F.col("__b").alias("__kb"), "__first")
    by = Window.partitionBy(*(f"__k{i}" for i in range(len(key)))).orderBy("__kb")
    places = places.withColumns({"__place": F.row_number().over(by), "__after": F.lead("__first").over(by)})
    opened = pieces.where("left OR right").join(places, same_key(key, "__k") & (F.col("__b") == F.col("__kb")))
    of_key = Window.partitionBy(*key, "threshold").orderBy("__b", "start", F.desc("left"))
    joins = F.col("left") & F.coalesce(F.lag("right").over(of_key) & (F.lag("__place").over(of_key) == F.col("__place") - 1), F.lit(False))
    opened = opened.withColumn("__joins", joins).withColumn("__chain", F.sum((~F.col("__joins")).cast("long")).over(of_key.rowsBetween(Window.unboundedPreceding, 0)))
    end = F.when(F.col("right"), F.coalesce("__after", F.col("last") + open_end)).otherwise(F.col("next"))
    across = opened.groupBy(*key, "threshold", "__chain").agg((F.max(end) - F.min("start")).alias("__long")).select("threshold", "__long")
    return inside.unionByName(across).where(F.col("__long") >= least).groupBy("threshold").agg(F.count("*").alias("n_segments"), F.sum("__long").alias("kept_us"))


def suppress(df: DataFrame, within: int, most: int, key: str = "video", t: str = "us", score: str = "score") -> DataFrame:
    """``key, t, score``: samples taken from the highest down (the earlier of equals), none less than ``within``
    from one taken before, ``most`` a key at most. Null scores don't count.

    Time is cut into buckets of ``within``. A taken sample rules out samples of three buckets at most, so while fewer than
    ``most`` are taken, one of the ``3 * most - 2`` buckets with the highest samples is free; nothing below the last of these
    highest samples can be taken. What is left of a key, a few buckets' worth (all of it if it has no more), is walked once
    from the highest down, and only the samples taken are held.
    """
    s = df.select(F.col(key).alias("__key"), F.col(t).alias("__t"), F.col(score).alias("__s")).where("__t IS NOT NULL AND __s IS NOT NULL")
    rank = F.struct(F.col("__s"), (-F.col("__t")).alias("__m"))
    buckets, _ = materialize(s.groupBy("__key", F.floor(F.col("__t") / within).alias("__b")).agg(F.max(rank).alias("__top"), F.count("*").alias("__n")), "suppression")
    place = F.row_number().over(Window.partitionBy("__key").orderBy(F.desc("__top")))
    bound = F.max(F.when(F.col("__place") == 3 * most - 2, F.col("__top"))).alias("__least")
    least = buckets.withColumn("__place", place).groupBy("__key").agg(bound, F.sum("__n").alias("__n"))
    total = buckets.agg(F.sum("__n")).first()[0] or 0
    high = dealt_join(s.withColumn("__key", _as_value("__key")), least.withColumn("__key", _as_value("__key")), "__key", ["__t"], "__n", total).where(F.col("__least").isNull() | (rank >= F.col("__least")))
    kinds = dict(df.dtypes)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, taken = [], []  # the key (in a list, if there is one) and its samples' times
        for b in batches:
            keys, times = b.column(0).to_pylist(), b.column(1).to_pylist()
            keep = []
            for i, (k, at) in enumerate(zip(keys, times, strict=True)):
                if current != [k]:
                    current, taken = [k], []
                if len(taken) < most and all(abs(at - x) >= within for x in taken):
                    taken.append(at)
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64()))

    ordered = high.select("__key.k", "__t", "__s").repartition("k").sortWithinPartitions(F.col("k"), F.desc("__s"), F.col("__t"))
    return ordered.mapInArrow(walk, f"`{key}` {kinds[key]}, `{t}` {kinds[t]}, `{score}` {kinds[score]}")


def _as_value(column: str) -> Column:
    """A struct of the column: null keys join like others."""
    return F.struct(F.col(column).alias("k"))
