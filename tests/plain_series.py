"""Plain definitions of series operators, one window by key: what the cut ones are held against."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.timeseries import SECOND, _ordered, chains


def segments(df: DataFrame, threshold: float, least: int, key: list[str] = ("video",), t: str = "us", score: str = "score", tie: str = "event_id", open_end: int = SECOND) -> DataFrame:
    """``key, start_us, end_us, n``: stretches of samples at or above ``threshold``. One ends at the first
    sample below it, or ``open_end`` after the last sample; those shorter than ``least`` are dropped."""
    w = _ordered(key, t, tie)
    above = F.coalesce(F.col(score) >= threshold, F.lit(False))
    marked = df.select(*key, t, tie, above.alias("__f")).withColumns({"__new": F.col("__f") & ~F.coalesce(F.lag("__f").over(w), F.lit(False)), "__next": F.lead(t).over(w)})
    marked = marked.withColumn("__island", F.sum(F.col("__new").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("__f")
    out = marked.groupBy(*key, "__island").agg(F.min(t).alias("start_us"), F.when(F.count("__next") == F.count("*"), F.max("__next")).otherwise(F.max(t) + open_end).alias("end_us"), F.count("*").alias("n"))
    return out.where(F.col("end_us") - F.col("start_us") >= least).drop("__island")


def peaks(df: DataFrame, threshold: float, gap: int, key: list[str] = ("video",), t: str = "us", score: str = "score", tie: str = "event_id") -> DataFrame:
    """``key, peak_us, peak_score, n``: of each chain of samples at or above the threshold the first highest."""
    up = chains(df.where(F.col(score) >= threshold), gap, key, t, tie)
    best = F.max_by(F.struct(F.col(t).alias("t"), F.col(score).alias("s")), F.struct(F.col(score), -F.col(t)))
    return up.groupBy(*key, "chain").agg(best.alias("__b"), F.count("*").alias("n")).select(*key, F.col("__b.t").alias("peak_us"), F.col("__b.s").alias("peak_score"), "n")


def lag_difference(df: DataFrame, key: list[str] = ("video",), t: str = "us", score: str = "score", tie: str = "event_id", to: str = "diff") -> DataFrame:
    """Absolute difference to the sample before; the first of a key has no row."""
    return df.withColumn(to, F.abs(F.col(score) - F.lag(score).over(_ordered(key, t, tie)))).where(F.col(to).isNotNull())


def moving_average(column: str, width: int, key: list[str] = ("video",), t: str = "us", tie: str = "event_id") -> Column:
    """Centred mean padded by zeros: the whole width divides, at the ends too. Series shorter than the
    width stay as they are. An even width reaches one row further back."""
    w = _ordered(key, t, tie)
    return F.when(F.count("*").over(Window.partitionBy(*key)) >= width, F.sum(column).over(w.rowsBetween(-(width // 2), width - 1 - width // 2)) / width).otherwise(F.col(column))


def best_window(df: DataFrame, length: int, key: list[str] = ("video",), t: str = "us", score: str = "score", skip_zero: bool = False) -> DataFrame:
    """``key, start_us, total``: the sample from which the scores within ``length`` (its end excluded) sum
    highest, the first of equals. With ``skip_zero`` keys whose scores are all 0 have no row."""
    w = Window.partitionBy(*key).orderBy(t).rangeBetween(0, length - 1)
    summed = df.select(*key, t, F.sum(F.col(score).cast("decimal(20,4)")).over(w).alias("total"))
    out = summed.groupBy(*key).agg(F.max_by(F.struct(F.col(t).alias("t"), F.col("total")), F.struct("total", -F.col(t))).alias("__b"))
    out = out.select(*key, F.col("__b.t").alias("start_us"), F.col("__b.total").cast("double").alias("total"))
    return out.where("total > 0") if skip_zero else out


def interpolate(queries: DataFrame, knots: DataFrame, key: list[str] = ("video",), t: str = "us", tie: str = "event_id", value: str = "score", to: str = "interpolated") -> DataFrame:
    """``queries`` and the knots' value at their times: linear between neighbours, the end values beyond
    them, null for keys without knots. No range join: both series meet in one ordered window."""
    extra = [c for c in queries.columns if c not in (*key, t, tie)]
    knot = knots.select(*key, t, F.col(tie), F.lit(0).alias("__q"), F.struct(F.col(t).alias("t"), F.col(value).alias("v")).alias("__k"), *(F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in extra))
    both = knot.unionByName(queries.select(*key, t, tie, F.lit(1).alias("__q"), F.lit(None).cast(knot.schema["__k"].dataType).alias("__k"), *extra))
    w = Window.partitionBy(*key).orderBy(t, "__q", tie)
    left = F.last("__k", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first("__k", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    both = both.withColumns({"__l": left, "__r": right}).where("__q = 1")
    lo, hi = F.col("__l"), F.col("__r")
    line = lo["v"] + (hi["v"] - lo["v"]) * (F.col(t) - lo["t"]) / (hi["t"] - lo["t"])
    return both.select(*queries.columns, F.when(lo.isNull(), hi["v"]).when(hi.isNull() | (lo["t"] == F.col(t)), lo["v"]).otherwise(line).alias(to))


def scale_to_max(column: str, key: list[str] = ("video",)) -> Column:
    """``column`` over its key's maximum, or as it is where that isn't above 0."""
    top = F.max(column).over(Window.partitionBy(*key))
    return F.when(top > 0, F.col(column) / top).otherwise(F.col(column))


def nearest(df: DataFrame, grid: DataFrame, reach: int, key: list[str] = ("video",), t: str = "us", tie: str = "event_id") -> DataFrame:
    """``grid`` (key, ``at``) and the nearest sample's time within ``reach``, the earlier of two as near."""
    w = Window.partitionBy(*key).orderBy("__t", "__g", tie)
    rows = df.select(*key, F.col(t).alias("__t"), F.lit(0).alias("__g"), F.col(tie)).unionByName(grid.select(*key, F.col("at").alias("__t"), F.lit(1).alias("__g"), F.lit(None).cast(df.schema[tie].dataType).alias(tie)))
    seen = F.when(F.col("__g") == 0, F.col("__t"))
    rows = rows.withColumns({"__b": F.last(seen, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__a": F.first(seen, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))}).where("__g = 1")
    before, after = F.col("__t") - F.col("__b"), F.col("__a") - F.col("__t")
    pick = F.when(F.col("__a").isNull() | (before <= after), F.col("__b")).otherwise(F.col("__a"))
    return rows.select(*key, F.col("__t").alias("at"), pick.alias("sample_us")).where(F.abs(F.col("sample_us") - F.col("at")) <= reach)


def sweep(df: DataFrame, thresholds: list[int], least: int, key: list[str] = ("video",), t: str = "us", score: str = "score", tie: str = "event_id", open_end: int = SECOND) -> DataFrame:
    """``threshold, n_segments, kept_us``: what stays of the series at each threshold.

    One sorted pass numbers the stretches of all thresholds; only samples above a threshold are counted for it, where they are.
    """
    w = _ordered(key, t, tie)
    rows = df.select(*key, t, tie, score, F.lag(score).over(w).alias("__before"), F.lead(t).over(w).alias("__next"))
    up = [F.coalesce(F.col(score) >= x, F.lit(False)) for x in thresholds]
    new = [u & ~F.coalesce(F.col("__before") >= x, F.lit(False)) for u, x in zip(up, thresholds, strict=True)]
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"__i{k}": F.sum(n.cast("long")).over(so_far) for k, n in enumerate(new)})
    each = F.array(*(F.struct(F.lit(x).alias("threshold"), u.alias("up"), F.col(f"__i{k}").alias("island")) for k, (u, x) in enumerate(zip(up, thresholds, strict=True))))
    rows = rows.select(*key, t, "__next", F.explode(F.filter(each, lambda e: e["up"])).alias("__e"))
    end = F.when(F.count("__next") == F.count("*"), F.max("__next")).otherwise(F.max(t) + open_end)
    found = rows.groupBy(*key, F.col("__e.threshold").alias("threshold"), F.col("__e.island").alias("island")).agg((end - F.min(t)).alias("__long"))
    return found.where(F.col("__long") >= least).groupBy("threshold").agg(F.count("*").alias("n_segments"), F.sum("__long").alias("kept_us"))
