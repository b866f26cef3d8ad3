"""One query per operator over the driver's tables: (spark, directory) -> DataFrame.

``events`` stand for score samples (user: recording, type: camera, value: score), ``orders`` for the manifest
of recordings, ``embeddings`` for feature vectors, ``pages`` for listings, ``conversations`` for captions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import events as E
from ..operators import foreground as G
from ..operators import frames as R
from ..operators import learning as L
from ..operators import timeseries as T
from ..operators import vectors as V
from ..sources import index_sink
from ..sources.shared import fresh_path
from ..sources.tables import followed, hrefs, micros, samples, table
from ..streaming import foreground as watch
from ..streaming import interpolation as merging
from ..streaming import sessions, state

Query = Callable[[SparkSession, str], DataFrame]
SEC, HOUR, DAY = 1_000_000, 3_600_000_000, 86_400_000_000
THRESHOLD = 60.0
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# --- time series


@query
def segments(spark, sf):
    return T.segments(samples(spark, sf), THRESHOLD, HOUR)


@query
def segments_by_camera(spark, sf):
    return T.segments(samples(spark, sf), THRESHOLD, DAY, ["video", "camera"])


@query
def majority_vote(spark, sf):
    found = T.segments(samples(spark, sf), THRESHOLD, 2 * DAY, ["video", "camera"])
    return E.vote(found, ["video"], "camera", 3)


@query
def peaks(spark, sf):
    return T.peaks(samples(spark, sf), THRESHOLD, 12 * HOUR)


def _slots(found):
    return T.merge_peaks(found, 12 * HOUR, HOUR)


@query
def merged_slots(spark, sf):
    return _slots(T.peaks(samples(spark, sf), THRESHOLD, 12 * HOUR, ["video", "camera"]))


def _presence_and_motion(spark, sf):
    s = samples(spark, sf)
    return s.where("camera = 'click'").select("event_id", "video", "us", "score"), s.where("camera = 'view'")


@query
def interp_join(spark, sf):
    presence, motion = _presence_and_motion(spark, sf)
    return T.interpolate(presence, motion).withColumn("interpolated", F.round("interpolated", 6))


@query
def detect_slots(spark, sf):
    presence, motion = _presence_and_motion(spark, sf)
    both = T.interpolate(presence, motion)
    weighed = both.withColumn("combined", F.coalesce(F.round(0.7 * F.col("score") + 0.3 * F.col("interpolated"), 6), F.col("score")))
    return T.merge_peaks(T.peaks(weighed, 0.7 * THRESHOLD, 12 * HOUR, score="combined"), 12 * HOUR, HOUR, tie="peak_us")


@query
def motion_diff(spark, sf):
    d = T.scaled_to_max(T.lag_difference(samples(spark, sf)), "diff")
    return T.smoothed(d.select("event_id", "video", "us", "diff"), "diff", 5).select("event_id", "video", F.round("smooth", 6).alias("motion"))


@query
def moving_avg_even(spark, sf):
    return T.smoothed(samples(spark, sf).select("event_id", "video", "us", "score"), "score", 6).select("event_id", "video", F.round("smooth", 6).alias("smooth"))


@query
def best_window(spark, sf):
    return T.best_window(samples(spark, sf), DAY, skip_zero=True)


@query
def nms_top(spark, sf):
    return T.suppress(samples(spark, sf), DAY, 6)


@query
def sample_frames(spark, sf):
    s = samples(spark, sf)
    ends = s.groupBy("video").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    grid = ends.select("video", F.explode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.col("lo") + F.floor(i * (F.col("hi") - F.col("lo")) / 16))).alias("at"))
    return T.nearest(s, grid, 365 * DAY)


@query
def threshold_sweep(spark, sf):
    return T.sweep(samples(spark, sf), list(range(40, 85, 5)), HOUR)


@query
def footage(spark, sf):
    s = samples(spark, sf)
    kept = T.segments(s, THRESHOLD, HOUR).groupBy("video").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("kept_us"))
    whole = s.groupBy("video").agg((F.max("us") - F.min("us")).alias("whole_us"))
    return whole.join(kept, "video", "left").select("video", F.coalesce("kept_us", F.lit(0).cast("long")).alias("kept_us"), F.round(F.coalesce(F.try_divide(100 * F.col("kept_us"), F.col("whole_us")), F.lit(0.0)), 6).alias("percent"))


@query
def early_stop(spark, sf):
    per = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.max((F.col("o_totalprice") > 450000).cast("int")).alias("confirmed"))
    return T.early_stop(per, 15, ["day"], "confirmed")


# --- aggregates and top rows


@query
def status_summary(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query
def series_summary(spark, sf):
    return samples(spark, sf).groupBy("video").agg(F.round(F.max("score"), 4).alias("top"), F.round(F.min("score"), 4).alias("low"), F.round(F.avg("score"), 6).alias("mean"), F.max_by("us", F.struct(F.col("score"), -F.col("us"))).alias("top_us"), F.count_if(F.col("score") >= THRESHOLD).alias("n_above"))


@query
def occupancy(spark, sf):
    s = samples(spark, sf)
    start = s.groupBy("video").agg(F.min("us").alias("t0"))
    e = F.col("t0") + 5 * DAY
    near = F.when((F.col("us") >= e - 2 * DAY) & (F.col("us") <= e + 2 * DAY), F.col("score"))
    return s.join(start, "video").groupBy("video").agg(F.round(F.avg((F.col("score") >= 50).cast("double")), 6).alias("occupancy"), F.coalesce(F.max(near), F.lit(0.0)).alias("event_max"))


@query
def verdict(spark, sf):
    s = samples(spark, sf).withColumn("bright", F.col("event_id") % 3 != 0)
    s = s.withColumn("gated", F.when(~F.col("bright"), 0.0).otherwise(F.col("score")))
    g = s.groupBy("video", "camera").agg(F.max("gated").alias("top"), F.count_if("bright").alias("n_bright"))
    return g.withColumn("verdict", F.when(F.col("n_bright") == 0, "ALL DARK").when(F.col("top") >= THRESHOLD, "DETECTED").otherwise("NOT FOUND"))


@query
def colour_gate(spark, sf):
    e = table(spark, sf, "events").select("user_id", micros("ts").alias("us"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    e = e.join(e.groupBy("user_id").agg(F.min("us").alias("t0")), "user_id")
    warm = F.when(F.col("us") < F.col("t0") + DAY, 0.0).otherwise(F.col("value"))
    g = e.groupBy(F.col("user_id").alias("video")).agg(F.round(F.avg((F.col("k") > 50).cast("double")), 6).alias("colour_share"), F.max(warm).alias("top"))
    return g.withColumn("status", F.when(F.col("colour_share") >= 0.5, "scored").otherwise("skipped"))


@query
def histogram40(spark, sf):
    s = samples(spark, sf)
    ends = s.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    place = F.coalesce(F.floor(F.try_divide((F.col("score") - F.col("lo")) * 40, F.col("hi") - F.col("lo"))), F.lit(0).cast("long"))  # a constant series is one bin
    return s.crossJoin(F.broadcast(ends)).groupBy(F.least(F.lit(39).cast("long"), place).alias("bin")).agg(F.count("*").alias("n"))  # one row of ends


@query
def totals_rollup(spark, sf):
    g = table(spark, sf, "lineitem").rollup("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_quantity").cast("decimal(18,2)")), 2).cast("double").alias("quantity"), F.grouping("l_returnflag").cast("int").alias("is_total"))
    return g


@query
def skip_reasons(spark, sf):
    o = table(spark, sf, "orders")
    price = F.col("o_totalprice")
    why = E.reason((price.isNull(), "unparseable"), (price < 1000, "too_short"), (price > 400000, "too_long"), (F.col("o_orderstatus") == "P", "pending"))
    return o.groupBy(F.coalesce(why, F.lit("extracted")).alias("reason")).agg(F.count("*").alias("n"))


@query
def top_global(spark, sf):
    return samples(spark, sf).select("event_id", "video", "us", "score").orderBy(F.desc("score"), "video", "us").limit(20)


@query
def top_frame_names(spark, sf):
    top = top_global(spark, sf).withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "video", "us")))  # 20 rows
    return top.select("event_id", S.frame_name(F.col("place"), F.col("video").cast("string"), F.floor(F.col("us") / SEC), F.col("score") / 100).alias("name"))


@query
def top_per_group(spark, sf):
    s = samples(spark, sf).where(F.col("score") >= THRESHOLD).select("event_id", "video", "score")
    return E.top_per_group(s, 3, ["video"], [F.desc("score"), F.col("event_id")])


@query
def head_tail(spark, sf):
    s = samples(spark, sf).select("event_id", "camera", "score")
    head = E.top_per_group(s, 8, ["camera"], [F.desc("score"), F.col("event_id")]).withColumn("part", F.lit("head"))
    return head.unionByName(E.top_per_group(s, 8, ["camera"], [F.col("score"), F.col("event_id")]).withColumn("part", F.lit("tail")))


@query
def best_detection(spark, sf):
    s = samples(spark, sf)
    return s.groupBy("video", "camera").agg(F.max_by(F.struct("event_id", "score"), F.struct(F.col("score"), -F.col("event_id"))).alias("b")).select("video", "camera", "b.event_id", "b.score")


@query
def middle_item(spark, sf):
    by = Window.partitionBy("video")
    place = F.row_number().over(by.orderBy(F.asc_nulls_last("event_id")))
    s = samples(spark, sf).select("video", "event_id").withColumn("place", place)
    n = s.groupBy("video").agg(F.count("event_id").alias("n"))
    return s.join(n, "video").groupBy("video").agg(F.max(F.when(F.col("place") == F.floor(F.col("n") / 2) + 1, F.col("event_id"))).alias("middle"))


# --- joins, manifest and events


@query
def clip_slices(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("video_id"), (F.floor(F.col("o_totalprice") / 1000)).cast("double").alias("duration"))
    return E.slices(o, "duration", 50.0, 100.0, "video_id")


@query
def event_segment_lookup(spark, sf):
    s = samples(spark, sf)
    events = s.where("camera = 'signup'").select("event_id", "video", F.col("us").alias("at"))
    recordings = s.where("camera = 'view'").select("video", F.col("us").alias("start"), F.lit(0).alias("rank"), F.col("event_id").alias("pos"))
    return E.lookup(events, recordings, DAY, DAY // 2, ["video"], "event_id", "at", "start", ["rank", "pos"]).select("event_id", "video", F.col("start").alias("start_us"), F.col("offset").alias("offset_us"))


@query
def session_fallback(spark, sf):
    s = samples(spark, sf)
    events = s.where("camera = 'signup'").select("event_id", "video", F.col("us").alias("at"))
    rank = F.when(F.col("camera") == "view", 0).when(F.col("camera") == "click", 1).otherwise(2)
    recordings = s.where("camera <> 'signup'").select("video", F.col("us").alias("start"), rank.alias("rank"), F.col("event_id").alias("pos"))
    return E.lookup(events, recordings, DAY, DAY // 2, ["video"], "event_id", "at", "start", ["rank", "pos"]).select("event_id", "rank", "pos")


@query
def resume_anti(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    return E.resume(o.where("o_orderstatus <> 'F'"), o.where("o_orderstatus = 'F'"), ["o_custkey", "o_orderpriority"], ["o_orderkey"])


@query
def existing_semi(spark, sf):
    big = table(spark, sf, "orders").where("o_totalprice > 400000")
    return table(spark, sf, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query
def missing_anti(spark, sf):
    big = table(spark, sf, "orders").where("o_totalprice > 400000")
    return table(spark, sf, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query
def camera_match(spark, sf):
    s = samples(spark, sf).withColumn("slot", F.floor(F.col("us") / DAY))
    ref = E.cameras_of_group(s.where("camera = 'view'"), ["video", "slot"], "camera", "event_id", ["us", "event_id"]).select("video", "slot", F.col("event_id").alias("view_id"))
    other = E.cameras_of_group(s.where("camera = 'click'"), ["video", "slot"], "camera", "event_id", ["us", "event_id"]).select("video", "slot", F.col("event_id").alias("click_id"))
    return ref.join(other, ["video", "slot"], "left")


@query
def cam_cross(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey").crossJoin(F.broadcast(table(spark, sf, "region").select("r_regionkey")))  # slots x cameras: a fixed, short list


@query
def manifest_upsert(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("source"))
    new = o.where("id % 3 = 0").unionByName(o.where("id % 3 = 0").withColumn("source", F.col("source") + 1))
    return E.upsert_ignore(o.where("id % 2 = 0"), new, "id", ["source"])


@query
def manifest_update(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("path"))
    u = o.where("id % 5 = 0").select("id", F.lit("done").alias("status"), F.lit(None).cast("string").alias("path"))
    return E.update_status(o, u, "id", ["status", "path"])


@query
def listing_hrefs(spark, sf):
    return hrefs(table(spark, sf, "pages").select("page_id", "html"))


@query
def parse_times(spark, sf):
    spellings = ["09:45", "~9:45", "9", "20:15 (?)", "~ 8:05!", "12:30:15", "25:99", "17??++", "17??", "noon", "1:2:3:4", "", "All day"]
    raw = F.element_at(F.array(*map(F.lit, spellings)), (F.col("o_orderkey") % len(spellings) + 1).cast("int"))
    t = table(spark, sf, "orders").select("o_orderkey", raw.alias("raw"))
    return t.select("o_orderkey", "raw", S.tolerant_time(F.col("raw")).alias("p"), S.strict_time(F.col("raw")).alias("strict_sec")).select("o_orderkey", "raw", "p.sec", "p.note", "strict_sec")


@query
def safe_label(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", S.safe_label(F.concat_ws(" / ", "c_name", "c_mktsegment")).alias("label"), S.url_part(F.concat_ws(" ", "c_name", "c_mktsegment")).alias("url_part"))


@query
def caption_merge(spark, sf):
    c = table(spark, sf, "conversations")
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("a"))
    return g.select("conv_id", F.array_join(F.transform("a", lambda x: F.concat_ws(":", x["turn"].cast("string"), x["role"])), ",").alias("captions"), F.size("a").cast("long").alias("n"))


@query
def roi_filter(spark, sf):
    i = F.col("event_id")
    e = samples(spark, sf).select("video", "score", (i % 100 / 100).alias("cx"), (i * 7 % 100 / 100).alias("cy"), (i % 600).alias("x1"), (i * 3 % 300).alias("y1"))
    share = S.inside(F.col("cx"), F.col("cy"), 0.25, 0.1, 0.75, 0.9)
    pixel = S.inside(S.pixel_centre(F.col("x1"), F.col("x1") + 41), S.pixel_centre(F.col("y1"), F.col("y1") + 60), 100, 40, 500, 250)
    top = F.coalesce(F.max(F.when(share, F.col("score"))), F.lit(0.0))
    return e.groupBy("video").agg(F.count_if(share).alias("n_inside"), F.count_if(pixel).alias("n_inside_pixels"), top.alias("top"))


# --- vectors


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "embedding", "label")


def _with_first(spark, sf, *ids):
    v = _vectors(spark, sf)
    for k, i in enumerate(ids):
        v = v.crossJoin(F.broadcast(table(spark, sf, "embeddings").where(F.col("vec_id") == i).select(F.col("embedding").alias(f"q{k}"))))  # one vector
    return v


@query
def cosine_query(spark, sf):
    return _with_first(spark, sf, 0).select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("q0")), 4).alias("similarity"))


@query
def softmax_score(spark, sf):
    v = _with_first(spark, sf, 0, 1)
    return v.select("vec_id", F.round(S.two_way_softmax(S.cosine(F.col("embedding"), F.col("q0"), 0.0), S.cosine(F.col("embedding"), F.col("q1"), 0.0), 10.0), 4).alias("score"))


@query
def baseline_threshold(spark, sf):
    v = _with_first(spark, sf, 0, 1).withColumn("similarity", F.round(S.cosine(F.col("embedding"), F.col("q0")), 4))
    return v.where(F.col("similarity") >= F.round(S.cosine(F.col("q0"), F.col("q1")), 4) + 0.05).select("vec_id", "similarity")


@query
def pair_similarity(spark, sf):
    """Every vector's three most similar, over the whole table."""
    return V.most_similar_of_all(_vectors(spark, sf), 3, "vec_id", "embedding")


@query
def pair_dissimilarity(spark, sf):
    v = _vectors(spark, sf)
    return V.most_similar(v.where("vec_id % 100 = 0"), v, 3, "vec_id", "embedding", largest=False)


@query
def mean_pool(spark, sf):
    return V.pooled(_vectors(spark, sf), "label", "embedding").select("label", F.posexplode("pooled").alias("pos", "x")).withColumn("x", F.round("x", 5))


@query
def median_background(spark, sf):
    v = _vectors(spark, sf).withColumn("pixels", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("long")))
    return V.pooled(v, "label", "pixels", "median").select("label", F.posexplode("pooled").alias("pos", "x"))


@query
def centroid_reps(spark, sf):
    return V.representatives(_vectors(spark, sf), 5, "label", "embedding", "vec_id").select("label", "vec_id", F.round("distance", 4).alias("distance"), "place")


# --- learning


@query
def auto_label(spark, sf):
    s = samples(spark, sf)
    return s.select("event_id", L.auto_label(F.col("score") / 100, F.col("video") % 10 == 0).alias("label")).where("label IS NOT NULL")


@query
def auc_by_group(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return L.auc(d, "n_chars", "quality", ["lang"])


@query
def class_report(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") > 1000).cast("int").alias("predicted")).join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return L.class_report(rows, "quality", "predicted")


@query
def pca_kmeans(spark, sf):
    return L.clusters(_vectors(spark, sf), "embedding", k=6, components=16).select("vec_id", "cluster")


@query
def logreg_leave_one_out(spark, sf):
    v = _vectors(spark, sf).withColumn("positive", (F.element_at("embedding", 1) > 0).cast("int"))
    return L.leave_one_group_out(v, "embedding", "positive", "label")


# --- streams


@query
def stream_sessions(spark, sf):
    return sessions.replay(spark, sf, "events.parquet", THRESHOLD, "12 hours")


@query
def stream_differences(spark, sf):
    return state.replay(spark, sf, "events.parquet").select("video", F.round("diff", 6).alias("diff"))


@query
def stream_interpolation(spark, sf):
    return merging.replay(spark, sf, "events.parquet", "click", "view").select("event_id", "video", "us", F.round("interpolated", 6).alias("interpolated"))


@query
def stream_index(spark, sf):
    """Events appended to the index as a stream brings them, read back as published."""
    _, raw = followed(spark, sf, "events.parquet")
    folder = fresh_path(spark, "index")
    index_sink.append(raw.select("event_id", F.col("event_type").alias("event"), F.when(F.col("value") < 10, "skipped").otherwise("extracted").alias("status")), folder, f"{folder}-state").awaitTermination()
    return index_sink.published(spark, folder, "event_id long, event string, status string").drop("batch")


# --- frames: vectors as tiny frames of grey pixels


def _frames(spark, sf):
    grey = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 255).cast("int"))
    return _vectors(spark, sf).select(F.col("label").alias("video"), F.col("vec_id").alias("us"), F.col("vec_id").alias("event_id"), grey.alias("pixels"))


@query
def motion_score(spark, sf):
    return R.motion_score(_frames(spark, sf)).withColumn("motion", F.round("motion", 6))


@query
def frame_stats(spark, sf):
    f = _frames(spark, sf)
    return f.select("us", F.round(R.brightness(F.col("pixels")), 6).alias("bright"), F.round(R.share_above(F.col("pixels"), 20), 6).alias("above"))


@query
def pixel_deviation(spark, sf):
    f = _frames(spark, sf)
    return R.deviation(f, f.where("us = 0")).select("us", F.round("deviation", 6).alias("deviation"))


#: A model of 8 x 8 pixels that suits so tiny frames.
SCENE = G.Settings(width=8, history=50, variance=25.0, opened=1, closed=3, low=0.01, high=0.5)


@query
def foreground(spark, sf):
    f = _frames(spark, sf).withColumn("us", (F.col("us") + 1) * SEC)  # a frame a second
    found = G.foreground(f, SCENE)
    return found.select("video", "us", "event_id", *(F.round(c, 9).alias(c) for c in ("foreground", "largest", "band")), "n_blobs")


@query
def stream_foreground(spark, sf):
    found = watch.replay(spark, sf, "embeddings.parquet", SCENE)
    return found.select("video", "us", "event_id", *(F.round(c, 9).alias(c) for c in ("foreground", "largest", "band")), "n_blobs")


@query
def blob_shares(spark, sf):
    f = G.blob_shares(_frames(spark, sf).select("event_id", "pixels"), 8, 20)
    inside = F.filter("blobs", lambda x: (x >= 0.05) & (x <= 0.3))
    return f.select("event_id", F.size("blobs").cast("long").alias("n_blobs"), F.size(inside).cast("long").alias("n_inside"), F.coalesce(F.array_max(inside) / 0.3, F.lit(0.0)).alias("score")).withColumn("score", F.round("score", 6))
