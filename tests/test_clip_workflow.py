"""Sources, writers, clips, saved models, density clusters and streams on small cases and by brute force."""

import json
import math
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import clips as C
from tidemark.operators import learning as L
from tidemark.operators import metrics
from tidemark.operators import frames as R
from tidemark.operators import timeseries as T
from tidemark.plans import catalog
from tidemark.scanner import Scanner
from tidemark.sources import frames, shared, tables, writers
from tidemark.streaming import scoring

SF = "/root/testdata/sf0.001"


def video(folder, name, n, fps=4, size=(2, 3), cut=0):
    raw = bytes(x for k in range(n) for x in [k] * (size[0] * size[1]))
    (folder / f"{name}.gray").write_bytes(raw[: len(raw) - cut])
    (folder / f"{name}.json").write_text(json.dumps({"fps": fps, "width": size[0], "height": size[1]}))


def test_frames_at_a_rate_within_bounds(spark, tmp_path):
    video(tmp_path, "a", 20)
    video(tmp_path, "b", 9, cut=2)
    got = [(r.video, r.k, r.t, r.pixels[0]) for r in frames.frames(spark, str(tmp_path), part_bytes=30).orderBy("video", "k").collect()]
    assert got == [("a", k, k / 4, k) for k in range(20)] + [("b", k, k / 4, k) for k in range(8)]
    slow = frames.frames(spark, str(tmp_path), 1.0)
    assert [(r.t, r.pixels[0]) for r in slow.where("video = 'a'").orderBy("t").collect()] == [(float(t), 4 * t) for t in range(5)]
    some = slow.where("t >= 1.0 AND t < 3.0 AND video = 'a'")
    assert sorted(r.t for r in some.collect()) == [1.0, 2.0]
    assert [r.pixels[0] for r in frames.frame_at(slow, "a", 2.0).collect()] == [8] and frames.frame_at(slow, "b", 2.0).count() == 0
    reader = frames.GreyVideoReader({"path": str(tmp_path), "scan_fps": "1"})
    list(reader.pushFilters([frames.GreaterThanOrEqual(("t",), 1.0), frames.LessThan(("t",), 3.0), frames.EqualTo(("video",), "a")]))
    assert [(p.video, p.first, p.end) for p in reader.partitions()] == [("a", 1, 4)]


def test_listings_files_and_bundles(spark, tmp_path):
    html = '<a href="x/"></a><a href="a.mp4">a</a><a href="b b.mp4">b</a>'
    pages = spark.createDataFrame([("cam", html), ("down", None), ("none", "")], "camera string, html string")
    assert [(r.camera, r.pos, r.href) for r in tables.videos(pages).orderBy("pos").collect()] == [("cam", 0, "a.mp4"), ("cam", 1, "b b.mp4")]
    for name in ("2.csv", "1.csv", "x.txt"):
        (tmp_path / name).write_text("Date,Event\n2026-3-7,eats\n")
    assert [(r.name, r.length) for r in tables.files(spark, str(tmp_path), "*.csv").collect()] == [("1.csv", 25), ("2.csv", 25)]
    assert [tuple(r) for r in tables.event_log(spark, str(tmp_path / "1.csv")).collect()] == [("2026-3-7", "", "eats", "", "")]
    np.savez(tmp_path / "v1.npz", ts=np.array([0.0, 5.0]), scores=np.array([0.25, 0.75]))
    assert sorted(map(tuple, tables.bundles(spark, str(tmp_path), "ts double, scores double").collect())) == [(0.0, 0.25, "v1"), (5.0, 0.75, "v1")]


def test_index_features_and_manifest_table(spark, tmp_path):
    assert writers.read_index(spark, str(tmp_path / "none.json"), "date string, n long").count() == 0
    (tmp_path / "i.json").write_text('[{"date": "d", "other": 1}, {"n": 2}]')
    assert sorted(map(str, map(tuple, writers.read_index(spark, str(tmp_path / "i.json"), "date string, n long").collect()))) == ["('d', None)", "(None, 2)"]
    with pytest.raises(ValueError, match="no feature"):
        writers.all_features(spark, str(tmp_path / "nothing"))
    rows = spark.createDataFrame([(f"v{i % 3}", i) for i in range(9)], "video_id string, x long")
    path = writers.write_series(rows, str(tmp_path / "features"))
    assert sorted(r.x for r in writers.read_series(spark, path, video_id="v1").collect()) == [1, 4, 7]
    assert [r.place for r in writers.concatenated(writers.all_features(spark, path), "video_id", ["x"]).orderBy("video_id", "x").collect()] == list(range(9))
    for _ in range(2):
        t = writers.ensure_manifest(spark, "manifest_of_test", str(tmp_path / "manifest"), "id long, status string")
    assert t.columns == ["id", "status"] and t.count() == 0
    spark.sql("DROP TABLE manifest_of_test")


def test_a_cluster_without_a_shared_folder_is_refused(spark):
    def session(master, setting=None, held=None):
        option = SimpleNamespace(isDefined=lambda: held is not None, get=lambda: held)
        java = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: option))
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *a: setting), sparkContext=SimpleNamespace(master=master, _jsc=java))

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        shared.shared_dir(session("spark://host:7077"))
    assert shared.shared_dir(session("yarn", "hdfs://a/b/")) == "hdfs://a/b" and shared.shared_dir(session("yarn", None, "s3a://c")) == "s3a://c"
    assert shared.shared_dir(session("local[2]")) == shared.LOCAL_SHARED
    assert "/tidemark-" in shared.fresh_path(spark, "x")


def test_windows_cuts_and_small_functions(spark):
    lo, hi = C.scan_window(F.lit(100).cast("long"), F.lit(1800).cast("long"), 150)
    boxes = S.crop_box(F.lit(0.0), F.lit(1.0), 64, 640, 360)
    r = spark.range(1).select(lo, hi, C.lead_in(F.lit(1).cast("long"), 2), C.lead_in(F.lit(9).cast("long"), 2, F.lit(8).cast("long")), boxes["x"], boxes["y"], S.file_stem(F.lit("a/b.c/093001--vv-1.mp4")), S.number_pair(F.lit("3, 1")).isNull(), S.cosine(F.array(F.lit(0.0)), F.array(F.lit(0.0)), 0.0)).first()
    assert tuple(r) == (0, 250, 0, 8, 0, 296, "093001--vv-1", True, None)
    clips = spark.createDataFrame([("a", "x.mp4"), ("b", "y.mp4"), ("a", "z.mp4")], "camera string, out string")
    there = spark.createDataFrame([("x.mp4", 20_000), ("y.mp4", 9)], "out string, length long")
    assert sorted((c.out, c.codec) for c in C.cut_manifest(clips, there, recoded=["a"]).collect()) == [("y.mp4", "copy"), ("z.mp4", "aac")]
    s = spark.createDataFrame([(i, "v", "c", i * 1_000_000, 1.0 if 3 <= i < 9 else 0.0) for i in range(12)], "event_id long, video string, camera string, us long, score double")
    assert [tuple(r) for r in Scanner().clips(s, there).collect()] == [("v", "c", 1_000_000, 9_000_000, "v_c_3.mp4", "copy")]


def test_suppression_of_equal_scores_and_a_hot_key(spark):
    s = spark.range(20_000).select(F.lit("v").alias("video"), (F.col("id") * 1_000_000).alias("us"), F.lit(1.0).alias("score"))
    got = T.suppress(s, 30_000_000, 6)
    assert sorted(r.us // 1_000_000 for r in got.collect()) == [0, 30, 60, 90, 120, 150]
    assert "Python" not in got._jdf.queryExecution().toString()


def test_early_stop_without_enough_keeps_all(spark):
    df = spark.createDataFrame([(k, c) for k, c in enumerate([0, 2, None, 1])], "k long, c int")
    assert T.early_stop(df, 9, ["k"], "c").count() == 4 and sorted(r.k for r in T.early_stop(df, 3, ["k"], "c").collect()) == [0, 1, 2, 3]
    assert sorted(r.k for r in T.early_stop(df, 2, ["k"], "c").collect()) == [0, 1]


def test_components_and_variance_equal_numpy(spark):
    v = catalog._vectors(spark, SF)
    x = np.array([r.embedding for r in v.orderBy("vec_id").collect()], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x -= x.mean(0)
    _, s, axes = np.linalg.svd(x, full_matrices=False)
    two, share = L.reduced(v, "embedding", 2)
    assert share == pytest.approx(float((s[:2] ** 2).sum() / (s**2).sum()), abs=1e-9)
    got = np.array([r.reduced.toArray() for r in two.orderBy("vec_id").collect()])
    assert np.abs(got) == pytest.approx(np.abs(x @ axes[:2].T), abs=1e-6)
    costs = [r.inertia for r in L.elbow(v, "embedding", 8, most=5, starts=2).orderBy("k").collect()]
    assert len(costs) == 3 and costs == sorted(costs, reverse=True)


def test_logistic_regression_equals_a_numpy_solve_and_survives_saving(spark, tmp_path):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(80, 3)), rng.random(80) < 0.4
    df = spark.createDataFrame([(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, v array<double>, y int")
    fitted = L.classifier(df, "v", "y")
    L.save_classifier(fitted, str(tmp_path / "m"))
    got = {r.id: r.score for r in L.scored(df.select("id", "v"), "v", L.load_classifier(str(tmp_path / "m"))).collect()}
    weight = np.where(y, 80 / (2 * y.sum()), 80 / (2 * (~y).sum()))
    z = np.c_[(x - x.mean(0)) / x.std(0, ddof=1), np.ones(80)]
    w, ridge = np.zeros(4), np.diag([1, 1, 1, 0]) / (0.1 * 80)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        k = weight / weight.sum()
        w -= np.linalg.solve((z * (k * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (k * (p - y)) + ridge @ w)
    assert [got[i] for i in range(80)] == pytest.approx((1 / (1 + np.exp(-z @ w))).tolist(), abs=1e-4)
    events = spark.createDataFrame([("s", 3)], "session string, at long")
    r = L.session_report(df.withColumn("session", F.lit("s")), fitted, "v", "session", "id", events, 2).first()
    assert (r.n, r.occupancy) == (80, pytest.approx(np.mean([got[i] >= 0.5 for i in range(80)]))) and r.event_max == pytest.approx(max(got[i] for i in range(1, 6)))


def test_failing_rows_keep_their_batch(spark):
    def score(values):
        if any(v is None or v < 0 for v in values):
            raise ValueError("bad")
        return [v + len(values) for v in values]

    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, -1, 3])] + [(4, None)], "id long, score double").coalesce(1)
    got = {r.id: (r.scored, r.error) for r in scoring.scored(df, score, size=2).collect()}
    assert got == {0: (3.0, None), 1: (4.0, None), 2: (None, "ValueError: bad"), 3: (4.0, None), 4: (None, "ValueError: bad")}


def test_runs_of_pixels_and_throughput(spark):
    rows = [(1, [0, 9, 9, 0, 9]), (2, []), (3, None), (4, [9]), (5, [0])]
    df = spark.createDataFrame(rows, "event_id long, pixels array<int>")
    assert sorted(map(tuple, R.runs(df, 5).collect())) == [(1, 1, 2), (1, 4, 4), (4, 0, 0)]
    m = metrics.throughput(df, 60.0)
    assert m["rows"] == 5 and m["rows_per_second"] > 0 and m["times_realtime"] > 0


def test_a_classifier_scores_after_an_observation(spark):
    df = spark.createDataFrame([(i, [float(i % 5), float(i % 3)], int(i % 5 > 2), i % 2) for i in range(40)], "id long, v array<double>, label int, g int")
    metrics.throughput(df)
    fitted = L.classifier(df, "v", "label")
    got = L.scored(df, "v", fitted)
    assert got.columns == [*df.columns, "score"]
    assert all((r.score >= 0.5) == (r.label == 1) for r in got.collect())
    assert {r.group: r.n for r in L.leave_one_group_out(df, "v", "label", "g").collect()} == {0: 20, 1: 20}
