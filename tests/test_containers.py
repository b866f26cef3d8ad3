"""Durations from file headers, medians from counts, and blobs of masks."""

import statistics

import pytest

from tidemark.operators import foreground as G
from tidemark.operators import vectors as V
from tidemark.sources import containers as C


def test_durations_read_heads_only(spark, tmp_path):
    movie = bytes(3_000_001)
    files = {
        "a.mp4": (C.mp4_head(90_500, 1000, movie), 90.5), "b.mp4": (C.mp4_head(2**33, 90_000, movie, 1), 2**33 / 90_000), "c.avi": (C.avi_head(33_367, 900, movie), 30.0303),
        "cut.mp4": (C.mp4_head(90_500, 1000, movie)[:2_000_000], 0.0), "none": (b"", 0.0), "text.mp4": (b"no film here at all", 0.0), "scale.mp4": (C.mp4_head(5, 0), 0.0),
        "zero.mp4": (C.box(b"ftyp", b"isom") + b"\0\0\0\0mdat" + bytes(50), 0.0), "bad.avi": (C.avi_head(1, 2)[:30], 0.0), "loop.mp4": (C.box(b"ftyp") + b"\0\0\0\1free" + bytes(8), 0.0),
    }
    wide = C.box(b"ftyp", b"isom") + b"\0\0\0\1mdat" + (16 + 1000).to_bytes(8, "big") + bytes(1000) + C.mp4_head(7, 2)
    files["wide.mp4"] = (wide, 3.5)
    (tmp_path / "deep").mkdir()
    for name, (data, _) in files.items():
        (tmp_path / ("deep" if name < "c" else ".") / name).write_bytes(data)
    listed = C.durations(spark, f"file://{tmp_path}").collect()
    empty = C.probed(spark.createDataFrame([(f"file://{tmp_path}/none",), (f"file://{tmp_path}/missing",), (None,)], "path string")).collect()
    assert [r.duration for r in empty] == [0.0, 0.0, 0.0] and all(r.error for r in empty) and files.pop("none")
    got = {r.path.rsplit("/", 1)[1]: r for r in listed}
    assert {n: r.duration for n, r in got.items()} == pytest.approx({n: d for n, (_, d) in files.items()})
    assert all((r.error is None) == (r.duration > 0) for r in got.values()) and max(r.bytes_read for r in got.values()) < 300


def test_medians_equal_plain_ones(spark):
    rows = [("a", [1, 5, None]), ("a", [2, 5, None]), ("a", [9, 6, 7]), ("b", [3]), ("b", [4]), ("c", []), ("d", None), (None, [8])]
    got = {(r.g, r.pos): r.x for r in V.medians(spark.createDataFrame(rows, "g string, v array<int>"), "g", "v").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        lists = [v for k, v in rows if k == g and v]
        for p in range(max(map(len, lists), default=0)):
            if known := [v[p] for v in lists if v[p] is not None]:
                want[g, p] = statistics.median(known)
    assert got == want


def test_blob_shares_of_odd_frames(spark):
    frames = spark.createDataFrame([(1, [9, 0, 9, 0]), (2, [9, 9, None]), (3, []), (4, None), (5, [0, 0])], "event_id long, pixels array<int>")
    assert {r.event_id: r.blobs for r in G.blob_shares(frames, 2, 5).collect()} == {1: [0.5], 2: [2 / 3], 3: [], 4: [], 5: []}
