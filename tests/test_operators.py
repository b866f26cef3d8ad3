"""Golden cases and brute-force twins of the score-series and event operators."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import events as E
from tidemark.operators import learning as L
from tidemark.operators import timeseries as T
from tidemark.operators import vectors as V

SEC = 1_000_000


def series(spark, t, s, video="v"):
    return spark.createDataFrame([(i, video, int(a * SEC), float(b)) for i, (a, b) in enumerate(zip(t, s, strict=True))], "event_id long, video string, us long, score double")


def spans(df):
    return sorted((r.start_us / SEC, r.end_us / SEC) for r in df.collect())


def test_segments_end_at_the_first_sample_below(spark):
    assert spans(T.segments(series(spark, [0, 5, 10, 15, 20], [0.8, 0.8, 0.3, 0.9, 0.9]), 0.7, 5 * SEC)) == [(0, 10), (15, 21)]
    assert spans(T.segments(series(spark, [0, 5, 10], [0.7, 0.1, 0.9]), 0.7, 5 * SEC)) == [(0, 5)]
    assert spans(T.segments(series(spark, [], []), 0.7, 5 * SEC)) == []


def test_a_null_score_is_below(spark):
    df = spark.createDataFrame([(0, "v", 0, 1.0), (1, "v", SEC, None), (2, "v", 2 * SEC, 1.0)], "event_id long, video string, us long, score double")
    assert spans(T.segments(df, 0.5, 0)) == [(0, 1), (2, 3)]


def test_peaks_join_within_the_gap(spark):
    df = series(spark, [0, 10, 20, 90, 100], [0.2, 0.9, 0.9, 0.8, 0.1])
    at = lambda gap: sorted(r.peak_us // SEC for r in T.peaks(df, 0.5, gap * SEC).collect())
    assert at(60) == [10, 90] and at(70) == [10]


def test_slots_are_padded_means(spark):
    rows = spark.createDataFrame([("v", c, p * SEC) for c, p in (("a", 200), ("b", 10), ("c", 60))], "video string, camera string, peak_us long")
    assert spans(T.merge_peaks(rows, 60 * SEC, 20 * SEC)) == [(15, 55), (180, 220)]
    assert spans(T.merge_peaks(rows.where("peak_us < 20000000").withColumn("peak_us", F.lit(5 * SEC)), 60 * SEC, 20 * SEC)) == [(0, 25)]


@pytest.mark.parametrize(("width", "want"), [(5, [1.2, 2, 3, 4, 3.6, 3]), (6, [1, 10 / 6, 2.5, 3.5, 20 / 6, 3])])
def test_smoothing_pads_with_zeros(spark, width, want):
    rows = T.smoothed(series(spark, range(6), range(1, 7)), "score", width, to="m").select("us", "m").orderBy("us").collect()
    assert [r.m for r in rows] == pytest.approx(want)


def test_interpolation_clamps_at_the_ends(spark):
    got = T.interpolate(series(spark, [0, 2.5, 7, 99], [0] * 4), series(spark, [1, 2, 6], [10, 20, 0])).orderBy("us").collect()
    assert [r.interpolated for r in got] == pytest.approx([10, 17.5, 0, 0])
    assert [r.interpolated for r in T.interpolate(series(spark, [1], [0]), series(spark, [], [])).collect()] == [None]


def test_best_window_takes_the_first_of_equals(spark):
    r = T.best_window(series(spark, [0, 5, 10, 15, 20], [0, 1, 0, 2, 0]), 15 * SEC).first()
    assert (r.start_us // SEC, r.total) == (5, 3)
    flat = series(spark, [3, 4], [0, 0])
    assert T.best_window(flat, SEC).first().start_us == 3 * SEC and T.best_window(flat, SEC, skip_zero=True).count() == 0


def test_suppression_golden_case_and_brute_force(spark):
    got = T.suppress(series(spark, [0, 59, 60, 130], [5, 4, 3, 2]), 60 * SEC, 6).collect()
    assert sorted(r.us // SEC for r in got) == [0, 60, 130]
    rng = random.Random(5)
    rows = [(i, f"v{i % 3}", rng.randrange(4000) * SEC, float(rng.randrange(50))) for i in range(1500)]
    df = spark.createDataFrame(rows, "event_id long, video string, us long, score double")
    want = set()
    for v in ("v0", "v1", "v2"):
        taken = []
        for _, _, us, s in sorted((r for r in rows if r[1] == v), key=lambda r: (-r[3], r[2], r[0])):
            if len(taken) < 6 and all(abs(us - x) >= 30 * SEC for x, _ in taken):
                taken.append((us, s))
        want |= {(v, *x) for x in taken}
    assert {tuple(r) for r in T.suppress(df, 30 * SEC, 6).collect()} == want


def test_raising_the_threshold_keeps_no_more(spark):
    rng = random.Random(2)
    df = series(spark, range(300), [rng.random() * 100 for _ in range(300)])
    kept = [r.kept_us for r in T.sweep(df, list(range(10, 95, 10)), 0).orderBy("threshold").collect()]
    assert all(a >= b for a, b in itertools.pairwise(kept))


def test_early_stop_keeps_the_row_that_reaches_the_target(spark):
    df = spark.createDataFrame(list(enumerate([0, 1, 1, 0, 1])), "k long, c int")
    assert sorted(r.k for r in T.early_stop(df, 2, ["k"], "c").collect()) == [0, 1, 2]


def test_lookup_prefers_rank_then_middle(spark):
    e = spark.createDataFrame([(1, "d", 36001), (2, "d", 90000)], "id long, date string, at long")
    r = spark.createDataFrame([("d", 34201, 0, 0), ("d", 36001, 0, 1), ("x", 36000, 0, 2)], "date string, start long, rank int, pos int")
    got = {x.id: (x.start, x.offset) for x in E.lookup(e, r, 1800, 900, ["date"], "id", "at", "start", ["rank", "pos"]).collect()}
    assert got == {1: (34201, 1800), 2: (None, None)}


def test_slices_drop_the_tail(spark):
    df = spark.createDataFrame([("a", 12.4), ("b", 10.0), ("c", 9.9)], "id string, d double")
    got = sorted((r.clip_id, r.start_sec, r.end_sec) for r in E.slices(df, "d", 5.0, 10.0, "id").collect())
    assert got == [("a_clip0000", 0, 5), ("a_clip0001", 5, 10), ("b_clip0000", 0, 5), ("b_clip0001", 5, 10)]


def test_vote_needs_two_cameras(spark):
    df = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "a"), ("h", "a")], "g string, camera string")
    assert [r.g for r in E.vote(df, ["g"], "camera", 2).collect()] == ["g"]


def test_upsert_and_update(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, path string")
    new = spark.createDataFrame([(2, "x"), (3, "z"), (3, "y")], "id long, path string")
    assert sorted(map(tuple, E.upsert_ignore(old, new, "id", ["path"]).collect())) == [(1, "a"), (2, "b"), (3, "y")]
    u = spark.createDataFrame([(1, None)], "id long, path string")
    assert sorted(map(tuple, E.update_status(old, u, "id", ["path"], keep_on_null=True).collect())) == [(1, "a"), (2, "b")]
    assert sorted(map(tuple, E.update_status(old, u, "id", ["path"]).collect())) == [(1, None), (2, "b")]
    twice = spark.createDataFrame([(1, "z"), (1, "y")], "id long, path string")
    assert sorted(map(tuple, E.update_status(old, twice, "id", ["path"]).collect())) == [(1, "y"), (2, "b")]


def test_dates_and_names(spark):
    r = spark.range(1).select(S.iso_date(F.lit("2026-3-7")).alias("d"), S.iso_date(F.lit("2026-3")).alias("n"), S.recording_seconds(F.lit("093001--vv-1.mp4")).alias("s"), S.minutes_seconds(F.lit(75)).alias("m"), S.safe_label(F.lit("é b/c")).alias("l")).first()
    assert tuple(r) == ("2026-03-07", None, 34201, "01:15", "é_b_c")


def test_auto_label_bands(spark):
    df = spark.createDataFrame([(0.55, False), (0.49, False), (0.50, False), (0.9, True)], "s double, neg boolean")
    assert [r.l for r in df.select(L.auto_label(F.col("s"), F.col("neg")).alias("l")).collect()] == [1, 0, None, 0]


def test_queries_have_a_checked_size(spark):
    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)], "id long, x array<double>")
    assert V.most_similar(v.where("id = 0"), v, 2, "id", "x").count() == 2
    with pytest.raises(ValueError, match="bytes"):
        V.most_similar(v, v, 2, "id", "x", query_bytes=10)


def test_mean_times_of_long_chains_are_exact(spark):
    """Sums of some thousand times pass a long, and quotients of doubles lost microseconds."""
    base, n = 1_704_067_200_000_001, 7_001
    df = spark.range(n).selectExpr("id % 1 AS video", f"{base}L + id * 1000003L AS peak_us", "'c' AS camera")
    (row,) = T.merge_peaks(df, 2_000_000, 5).collect()
    mid = sum(base + i * 1_000_003 for i in range(n)) // n
    assert (row.start_us, row.end_us, row.n) == (mid - 5, mid + 5, n)
    few = [base + x for x in (0, 1, 3, 4, 6, 8, 9)]
    (row,) = T.merge_peaks(spark.createDataFrame([(1, t, "c") for t in few], "video long, peak_us long, camera string"), 10, 5).collect()
    assert row.end_us == sum(few) // 7 + 5
    (row,) = T.merge_peaks(spark.createDataFrame([(1, -9, "c"), (1, -4, "c")], "video long, peak_us long, camera string"), 10, 5).collect()
    assert row.end_us == -1  # as SQL's whole quotient


@pytest.mark.parametrize("largest", [True, False])
def test_most_similar_equals_all_pairs_with_ties_and_rows_without_similarity(spark, largest):
    """All pairs were rows. Halves, equal vectors, vectors of length 0 and null ones keep the order that the SQL gives them (nulls last)."""
    rng = random.Random(3)
    rows = [(i, [rng.choice((-1.0, 0.25, 0.5, 1.0)) for _ in range(4)]) for i in range(400)] + [(i, None if i % 2 else [0.0] * 4) for i in range(400, 410)]
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(5)
    found = V.most_similar(df.where("id % 20 = 0"), df, 7, "id", "v", largest)
    assert "CartesianProduct" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
    q = df.where("id % 20 = 0").select(F.col("id").alias("query"), F.col("v").alias("w"))
    s = q.crossJoin(df.select(F.col("id").alias("match"), "v")).where("query <> match").select("query", "match", F.round(S.cosine(F.col("w"), F.col("v"), 0.0), 4).alias("s"))
    want = {}
    for r in s.collect():
        want.setdefault(r.query, []).append((r.s is None, 0 if r.s is None else -r.s if largest else r.s, r.match, r.s))
    got = sorted(map(tuple, found.select("query", "place", "match", "similarity").collect()))
    assert got == [(k, i + 1, m, x) for k in sorted(want) for i, (_, _, m, x) in enumerate(sorted(want[k])[:7])]


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("largest", [True, False])
def test_most_similar_of_all_equals_all_pairs(spark, largest, kind):
    """Every row is a query, over several groups; ties, equal vectors, repeated keys and rows without similarity keep the order of the SQL (nulls last)."""
    rng = random.Random(5)
    vector = lambda i: [0.5] * 4 if i % 9 == 0 else [rng.choice((-1.0, 0.25, 0.5, 1.0, rng.random())) for _ in range(4)]
    odd = [(200, None), (-3, [0.0] * 4), (202, [1.0, None, 0.5, 1.0]), (203, [1.0]), (204, []), (7, None), (None, [1.0] * 4)]
    rows = [(i, vector(i)) for i in range(200)] + [(i, vector(i)) for i in (5, 5, 70)] + odd
    check_all_pairs(spark, rows, kind, 7, largest, group_rows=30)


def test_most_similar_of_all_fills_up_with_rows_without_similarity(spark):
    none = [(i, None if i % 2 else [0.0, 0.0]) for i in range(9)]
    for sound in ([], [(4, [1.0, 2.0])], [(4, [1.0, 2.0]), (20, [2.0, 1.0]), (20, [2.0, 1.5])]):
        check_all_pairs(spark, none + sound, "double", 4, True)
    check_all_pairs(spark, [(1, [1.0, 2.0]), (2, [2.0, 1.0])], "double", 4, True)
    assert V.most_similar_of_all(spark.createDataFrame([], "id long, v array<float>"), 3, "id", "v").collect() == []


def check_all_pairs(spark, rows, kind, n, largest, **more):
    df = spark.createDataFrame(rows, f"id int, v array<{kind}>").repartition(5)
    found = V.most_similar_of_all(df, n, "id", "v", largest, **more)
    assert "CartesianProduct" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
    length = max((len(v) for i, v in rows if i is not None and v), default=1)
    value = F.when((F.size("v") == length) & (F.size("w") == length), F.round(S.cosine(F.col("w"), F.col("v"), 0.0), 4))
    q = df.select(F.col("id").alias("query"), F.col("v").alias("w"))
    want = {}
    for r in q.crossJoin(df.select(F.col("id").alias("match"), "v")).where("query <> match").select("query", "match", value.alias("s")).collect():
        want.setdefault(r.query, []).append((r.s is None, 0 if r.s is None else -r.s if largest else r.s, r.match, r.s))
    key = lambda r: r[:2]
    got = sorted(map(tuple, found.select("query", "place", "match", "similarity").collect()), key=key)
    assert got == [(k, i + 1, m, x) for k in sorted(want) for i, (_, _, m, x) in enumerate(sorted(want[k], key=lambda r: r[:3])[:n])]
    assert dict(found.dtypes) == {"query": "int", "match": "int", "similarity": "double", "place": "int"}
