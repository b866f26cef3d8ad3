"""Frames as a stream over growing files and restarts; every vector's neighbours by the index."""

import json

import numpy as np
import pytest

from tidemark.operators import density as D
from tidemark.sources import frames as R
from tidemark.sources.shared import fresh_path


def grow(folder, video, frames, fps=2, cut=0):
    (folder / f"{video}.json").write_text(json.dumps({"fps": fps, "width": 4, "height": 2}))
    with open(folder / f"{video}.gray", "ab") as f:
        f.write(b"".join(bytes([k] * 8) for k in frames) + bytes(cut))


@pytest.mark.parametrize("batch_bytes", [None, 40])
def test_each_frame_once_over_restarts(spark, tmp_path, batch_bytes):
    folder = tmp_path / "videos"
    folder.mkdir()
    out = fresh_path(spark, "frames")
    options = {"part_bytes": 24} | ({"batch_bytes": batch_bytes, "progress": f"{tmp_path}/progress"} if batch_bytes else {})

    def follow(times=1):
        for _ in range(times):
            q = R.frame_stream(spark, str(folder), **options).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
            q.awaitTermination()

    def got():
        rows = spark.read.schema(R.SCHEMA).parquet(f"{out}/rows").collect()
        assert all(r.t == r.k / 2 and bytes(r.pixels) == bytes([r.k] * 8) for r in rows)
        return sorted((r.video, r.k) for r in rows)

    grow(folder, "a", range(9))
    grow(folder, "b", range(2))
    follow()
    first = got()
    assert first == [("a", k) for k in range(9)] + [("b", k) for k in range(2)] if not batch_bytes else {v for v, _ in first} == {"a", "b"} and len(first) == 5
    follow(4)
    assert got() == [("a", k) for k in range(9)] + [("b", k) for k in range(2)]
    grow(folder, "a", range(9, 12))
    grow(folder, "c", range(3), cut=5)
    follow(4)
    want = [("a", k) for k in range(12)] + [("b", k) for k in range(2)] + [("c", k) for k in range(3)]
    assert got() == want
    follow(2)
    assert got() == want


def test_admission_needs_a_place_to_note_it():
    with pytest.raises(ValueError, match="progress"):
        R.GreyVideoStream({"path": "/none", "batch_bytes": "5"})


def brute(keys, x, n):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i, k in enumerate(keys):
        near = sorted((d[i, j], keys[j]) for j in range(len(keys)) if j != i)[:n]
        out += [(k, m, a, p + 1) for p, (a, m) in enumerate(near)]
    return sorted(out)


def test_neighbours_are_exact_and_recall_is_measured(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 1, (60, 6)) for c in (0, 4, 9)])
    x[5] = x[9] = x[70]
    keys = rng.permutation(1000)[: len(x)].tolist()
    df = spark.createDataFrame([(k, v.tolist()) for k, v in zip(keys, x, strict=True)] + [(5000, None)], "id long, v array<double>")
    want = brute(keys, x, 4)
    assert sorted(map(tuple, D.neighbours(df, "id", "v", 4, pivots=7, block=16).collect())) == want
    few = {(r.id, r.match) for r in D.neighbours(df, "id", "v", 4, probes=2, pivots=7, block=16).collect()}
    assert len(few & {r[:2] for r in want}) >= 0.9 * len(want)
    assert D.neighbours(df.where("id = 5000"), "id", "v", 4).collect() == []
