"""The mixture, masks and blobs against plain loops per pixel; the stream against the batch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import foreground as G
from tidemark.sources.shared import fresh_path
from tidemark.streaming import foreground as S

SETTINGS = G.Settings(width=8, history=6, components=3, opened=1, closed=3, low=0.02, high=0.4, bright=1.0, idle=40_000_000)


def plain_mixture(frames, s):
    """Lists of [weight, mean, variance] a pixel, one pixel at a time."""
    pixels = [[] for _ in frames[0]]
    for n, frame in enumerate(frames, 1):
        rate, mask = 1 / min(n, s.history), []
        for p, x in enumerate(frame):
            comps, sofar, inside = pixels[p], 0.0, False
            for w, m, v in comps:
                if sofar < s.background and (x - m) ** 2 < s.variance * v:
                    inside = True
                sofar += w
            mask.append(not inside and n > 1)
            own = next((c for c in comps if (x - c[1]) ** 2 < s.own * c[2]), None)
            for c in comps:
                c[0] *= 1 - rate
            if own:
                own[0] += rate
                d, step = x - own[1], rate / own[0]
                own[1] += step * d
                own[2] = min(max(own[2] + step * (d * d - own[2]), s.least_variance), s.most_variance)
            else:
                if len(comps) == s.components:
                    comps.pop()
                comps.append([rate, float(x), s.first_variance])
            total = sum(c[0] for c in comps)
            for c in comps:
                c[0] /= total
            comps[:] = sorted((c for c in comps if c[0] > 0), key=lambda c: -c[0])
        yield mask


def plain_morphology(mask, size, erode):
    h, w = mask.shape
    out = np.zeros_like(mask)
    for i in range(h):
        for j in range(w):
            seen = [mask[i + a, j + b] for a, b in G.kernel(size) if 0 <= i + a < h and 0 <= j + b < w]
            out[i, j] = all(seen) if erode else any(seen)
    return out


def flood(mask):
    left, areas = {(int(i), int(j)) for i, j in zip(*np.nonzero(mask), strict=True)}, []
    while left:
        work, n = [min(left)], 0
        left.discard(work[0])
        while work:
            i, j = work.pop()
            n += 1
            near = {(i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            work += near
        areas.append(n)
    return areas


def test_mixture_equals_plain_loops():
    rng = np.random.default_rng(4)
    frames = [np.where(rng.random(24) < 0.15, rng.integers(0, 256, 24), np.array([40, 90] * 12)[:24] + rng.integers(-3, 4, 24) + 60 * (t % 4 == 0)) for t in range(60)]
    model = G.Mixture(SETTINGS, 24)
    got = [model.apply(f.astype(float)).tolist() for f in frames]
    assert got == list(plain_mixture(frames, SETTINGS)) and 0.02 < np.mean(got) < 0.6
    again = G.Mixture.from_bytes(SETTINGS, model.to_bytes(), model.seen)
    assert (again.apply(frames[3].astype(float)) == model.apply(frames[3].astype(float))).all()


@pytest.mark.parametrize("size", [1, 3, 5, 7])
def test_masks_and_blobs_equal_plain_loops(size):
    rng = np.random.default_rng(size)
    for share in (0.0, 0.1, 0.4, 0.6, 0.9, 1.0):
        mask = rng.random((17, 23)) < share
        assert (G.eroded(mask, size) == plain_morphology(mask, size, True)).all()
        assert (G.dilated(mask, size) == plain_morphology(mask, size, False)).all()
        assert G.blobs(mask).tolist() == flood(mask)
        opened = plain_morphology(plain_morphology(mask, size, True), size, False)
        assert (G.cleaned(mask, size, 3) == plain_morphology(plain_morphology(opened, 3, False), 3, True)).all()
    assert sum(x == (0, 0) for x in G.kernel(size)) == 1 and len(G.kernel(5)) == 17


def camera_rows():
    """Two cameras, one with a long pause and a dark stretch; a bright square crosses."""
    rng, rows = np.random.default_rng(9), []
    for video in (1, 2):
        for t in range(60):
            at = 1 + t + (100 if video == 2 and t >= 40 else 0)
            frame = rng.integers(38, 42, (8, 8))
            if t % 7 == 3:
                frame[t % 5 : t % 5 + 3, 2:5] = 200
            if 20 <= t < 24:
                frame[:] = 0
            rows.append((video, at * 1_000_000, 100 * video + t, frame.ravel().tolist()))
    return [*rows, (1, 30_500_000, 999, None)]


def twin(rows, s):
    out = []
    for video in sorted({r[0] for r in rows}):
        held, last, masks = [], None, {}
        mine = sorted(r for r in rows if r[0] == video)
        for _, us, event_id, pixels in mine:
            if last is not None and us - last > s.idle:
                held = []
            last = us
            if not pixels or np.mean(pixels) < s.bright:
                out.append((video, us, event_id, 0.0, 0, 0.0, 0.0))
                continue
            held.append(pixels)
            odd = np.array(list(plain_mixture(held, s))[-1])
            mask = odd.reshape(-1, s.width)
            for size, erode in ((s.opened, True), (s.opened, False), (s.closed, False), (s.closed, True)):
                mask = plain_morphology(mask, size, erode)
            areas = [a / len(pixels) for a in flood(mask)]
            out.append((video, us, event_id, float(odd.mean()), len(areas), max(areas, default=0.0), max((a for a in areas if s.low <= a <= s.high), default=0.0) / s.high))
    return out


@pytest.fixture(scope="module")
def expected():
    return sorted(twin(camera_rows(), SETTINGS))


def test_batch_equals_the_twin(spark, expected):
    df = spark.createDataFrame(camera_rows(), "video long, us long, event_id long, pixels array<int>").repartition(5)
    got = sorted(map(tuple, G.foreground(df, SETTINGS).collect()))
    assert [tuple(pytest.approx(x) if isinstance(x, float) else x for x in r) for r in expected] == got
    assert any(r[4] for r in got) and G.foreground(df.where("us < 0"), SETTINGS).collect() == []


def test_stream_equals_the_batch_over_a_restart(spark, expected, tmp_path):
    rows = camera_rows()
    source, out = str(tmp_path / "frames"), fresh_path(spark, "watched")
    df = spark.createDataFrame(rows, "video long, us long, event_id long, pixels array<int>").withColumn("ts", F.timestamp_micros("us"))
    schema = df.schema

    def put(low, high):
        # within a batch, frames lie in no order and over several files
        df.where((F.col("us") >= low) & (F.col("us") < high)).orderBy(F.rand(3)).repartition(3).write.mode("append").parquet(source)

    def watch():
        S.run(spark.readStream.schema(schema).parquet(source), SETTINGS, out, "5 seconds")

    put(0, 25_000_000)
    watch()
    some = spark.read.schema(S.ROWS).parquet(f"{out}/rows").count()
    assert 0 < some < len(rows)
    put(25_000_000, 110_000_000)
    watch()
    put(110_000_000, 10**12)
    spark.createDataFrame([(3, 900_000_000, 5, [40] * 64)], "video long, us long, event_id long, pixels array<int>").withColumn("ts", F.timestamp_micros("us")).write.mode("append").parquet(source)
    watch()
    got = sorted(map(tuple, spark.read.schema(S.ROWS).parquet(f"{out}/rows").where("video < 3").collect()))
    assert [tuple(pytest.approx(x) if isinstance(x, float) else x for x in r) for r in expected] == got
    # cameras that were idle hold no model, and no frame waits but one within the delay of the last
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.ROCKSDB)
    try:
        held = spark.read.format("statestore").option("path", f"{out}/state").option("stateVarName", "model").load().count()
        waits = spark.read.format("statestore").option("path", f"{out}/state").option("stateVarName", "waiting").load().select("key.video").distinct().collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert held == 0 and [r.video for r in waits] == [3]


def test_query_of_the_stream_equals_the_batch_s(spark):
    from tidemark.plans import catalog

    sf = "/root/testdata/sf0.001"
    one, two = (sorted(map(tuple, catalog.QUERIES[n](spark, sf).collect())) for n in ("foreground", "stream_foreground"))
    assert len(one) > 100 and two == one
