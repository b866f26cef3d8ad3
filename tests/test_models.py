"""Models fitted side by side against the same fitted apart, plain numpy and MLlib."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import learning as L
from tidemark.operators import models as M


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.8, (60, 4)) for c in (0, 3, 7, 12)])
    rows = [(i, v.tolist(), i % 5, int(v[0] + rng.normal(0, 2) > 4)) for i, v in enumerate(x)]
    return spark.createDataFrame([*rows, (999, None, 1, 1)], "id long, x array<double>, g long, y int").repartition(3).cache()


def lloyd(x, centres, scale):
    while True:
        d = ((x[:, None] - centres[None]) ** 2).sum(-1)
        place = d.argmin(1)
        moved = np.array([x[place == k].mean(0) if (place == k).any() else centres[k] for k in range(len(centres))])
        if ((moved - centres) ** 2).sum() <= 1e-4 * scale:
            return centres, d.min(1).sum()
        centres = moved


def test_all_sizes_and_starts_equal_plain_ones(spark, vectors, monkeypatch):
    x = np.array([r.x for r in vectors.where("x IS NOT NULL").orderBy("id").collect()])
    jobs, plain = [], M.summed
    monkeypatch.setattr(M, "summed", lambda *a: jobs.append(1) or plain(*a))
    found = M.kmeans(vectors, "x", range(2, 8), starts=4)
    assert len(found) == 24 and len(jobs) == max(m.rounds for m in found.values())
    sample = np.array([r.x for r in vectors.where("x IS NOT NULL").orderBy(F.xxhash64("x"), "x").collect()])
    for (k, start), m in found.items():
        centres, inertia = lloyd(x, M.spread_out(sample, k, np.random.default_rng([42, k, start])), x.var(0).mean())
        assert m.places == pytest.approx(centres) and m.inertia == pytest.approx(inertia)
    alone = M.kmeans(vectors, "x", [5], starts=4)
    assert all(alone[5, s].inertia == pytest.approx(found[5, s].inertia) for s in range(4))
    placed = {r.id: r.cluster for r in M.assigned(vectors, "x", M.best(found, 4)).collect()}
    assert placed.pop(999) is None and len(set(placed.values())) == 4
    assert [placed[i] for i in range(240)] == ((x[:, None] - M.best(found, 4).places[None]) ** 2).sum(-1).argmin(1).tolist()


def test_elbow_falls_over_its_whole_range(vectors):
    rows = L.elbow(vectors.where("x IS NOT NULL"), "x", 3, starts=3).orderBy("k").collect()
    assert [r.k for r in rows] == list(range(2, 15))
    assert all(a.inertia > b.inertia for a, b in zip(rows[:-4], rows[4:], strict=True))
    assert L.elbow(vectors.where("id < 3"), "x", 2).count() == 1


def test_folds_equal_separate_fits(vectors):
    known = vectors.where("x IS NOT NULL")
    folds = M.group_folds(vectors, "x", "y", "g")
    assert sorted(folds) == [0, 1, 2, 3, 4] and max(f.rounds for f in folds.values()) < 20
    scores = M.fold_scores(vectors, folds, "x", "y", "g")
    for g in folds:
        want = sorted(r.score for r in L.scored(known.where(F.col("g") == g), "x", L.classifier(known.where(F.col("g") != g), "x", "y")).collect())
        assert sorted(r.score for r in scores.where(F.col("group") == g).collect()) == pytest.approx(want, abs=2e-4)
        assert all(a >= b for a, b in zip(folds[g].path[:-1], folds[g].path[1:], strict=True))


def test_groups_without_two_classes(spark):
    rows = [(0, [1.0, 5.0], 1), (0, [2.0, 5.0], 1), (1, [0.0, 5.0], 0), (1, [0.5, 5.0], 0), (2, [3.0, 5.0], 1), (None, [3.0, 5.0], 1), (2, None, 0)]
    df = spark.createDataFrame(rows, "g long, x array<double>, y int")
    assert sorted(M.group_folds(df, "x", "y", "g")) == [0, 2]
    got = {r.group: (r.n, r.n_positive, r.auc) for r in L.leave_one_group_out(df, "x", "y", "g").collect()}
    assert got == {0: (2, 2, None), 2: (1, 1, None)}
    assert M.group_folds(df.where("y > 5"), "x", "y", "g") == {} and M.kmeans(df.where("y > 5"), "x", [2]) == {}


def test_a_pass_compares_rows_with_the_centres_of_all_models_at_once(spark, monkeypatch):
    """Each model took its own products and sums of every row; rows between two equal centres belong to the first."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3_000, 6))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>")
    batch = pa.RecordBatch.from_arrays([pa.array(list(x))], names=["x"])
    passes = []
    monkeypatch.setattr(M, "nearest", lambda *a: pytest.fail("a model's own pass"))
    monkeypatch.setattr(M, "summed", lambda rows, per_batch: passes.append(per_batch(batch)) or passes[-1])
    monkeypatch.setattr(M, "spread_out", lambda sample, k, rng: np.concatenate([x[: k - 1], x[:1]]))
    M.kmeans(df, "x", [2, 5], 2, most_rounds=0)
    for i, k in enumerate((2, 2, 5, 5)):
        c = np.concatenate([x[: k - 1], x[:1]])
        far = ((x[:, None] - c[None]) ** 2).sum(-1)
        n, sums, inertia = passes[0][i][:k], passes[0][i][k:-1].reshape(k, 6), passes[0][i][-1]
        place = far.argmin(1)
        assert n.tolist() == np.bincount(place, minlength=k).tolist() and n[-1] == 0
        assert np.allclose(sums, [x[place == j].sum(0) for j in range(k)], atol=1e-9) and inertia == pytest.approx(far.min(1).sum())
