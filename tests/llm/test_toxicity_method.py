"""The counterfactual penalty: its gradient by brute force, and what it does on the driver's documents."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import toxicity
from tidemark.llm.common import table

SF = "/root/testdata/sf0.01"


def test_gradient_equals_brute_force():
    rng = random.Random(4)
    width, n = 7, 12
    rows = [Counter({c: rng.randrange(1, 4) for c in rng.sample(range(width), rng.randrange(0, 5))}) for _ in range(n)]
    swaps = [Counter({c: rng.choice([-1, 1, 2]) for c in rng.sample(range(width), 2)}) for _ in range(5)]
    y, weight = np.array([rng.randrange(2) for _ in range(n)], float), np.array([rng.random() for _ in range(n)])
    w, b, fairness, l2 = np.array([rng.gauss(0, 1) for _ in range(width)]), 0.3, 2.5, 0.1

    def loss(w, b):
        out = l2 / 2 * sum(x * x for x in w)
        for r, t, k in zip(rows, y, weight, strict=True):
            z = b + sum(v * w[c] for c, v in r.items())
            out += k * (math.log(1 + math.exp(-z)) if t else math.log(1 + math.exp(z)))
        return out + fairness * sum(sum(v * w[c] for c, v in s.items()) ** 2 for s in swaps) / len(swaps)

    g, gb = toxicity.gradient(toxicity.SparseRows(*toxicity.cells(rows), width), toxicity.SparseRows(*toxicity.cells(swaps), width), y, weight, w, b, fairness, l2)
    h = 1e-6
    for k in range(width):
        step = np.eye(width)[k] * h
        assert g[k] == pytest.approx((loss(w + step, b) - loss(w - step, b)) / (2 * h), abs=1e-6)
    assert gb == pytest.approx((loss(w, b + h) - loss(w, b - h)) / (2 * h), abs=1e-6)


def test_changes_are_those_of_the_swapped_text():
    assert toxicity.swap_terms("Women and MEN met a woman.") == "men and people met a man."
    d = toxicity.changes("the muslims waved")
    assert d == toxicity.changes("muslims") and d[toxicity.bucket("=muslims")] == 1 and d[toxicity.bucket("=jews")] == -1
    assert not toxicity.changes("nobody is named") and len(toxicity.mentions()) > 60


def test_the_penalty_acts_on_the_documents(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    fair, free = (toxicity.fit(docs, labels, fairness=x) for x in (1.0, 0.0))
    assert fair.weights != free.weights and fair.counterfactuals[1] > 60
    heaviest = lambda m: max(abs(sum(m.weights.get(f, 0.0) * v for f, v in c.items())) for c in toxicity.mentions())
    assert heaviest(fair) < 0.5 * heaviest(free)


def test_sample_bounds(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    few = toxicity.fit(docs, labels, most_cells=20_000)
    assert few.weights and few.intercept != toxicity.fit(docs, labels, per_class=20).intercept


def test_clashing_columns_and_an_id_with_two_texts(spark):
    bad, good = "you scum you loser", "the boats come in at noon"
    rows = [(i, bad if i % 2 else good) for i in range(40)] + [(1, "z " + good)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    clash = docs.select("doc_id", "text", *(F.lit(7).alias(c) for c in ("score", "predicted", "toxic", "__id", "columns", "counts")))
    model, same = toxicity.fit(docs, labels), toxicity.fit(clash, labels.withColumn("__text", F.lit(1)))
    assert model == same
    assert {tuple(r) for r in toxicity.score(clash, model).collect()} == {tuple(r) for r in toxicity.score(docs, model).collect()}
    kept = toxicity.reject(clash, model)
    assert kept.columns == clash.columns and {r.doc_id for r in kept.collect()} == {i for i in range(40) if i % 2 == 0} | {1}


def test_a_dense_twin_gives_the_same_scores():
    """The same loss, by plain proximal steps on full matrices."""
    rng = random.Random(11)
    words = [f"w{chr(97 + i)}{chr(97 + j)}x" for i in range(6) for j in range(6)]
    texts = [" ".join(rng.sample(words, rng.randrange(3, 12)) + (["women"] if i % 5 == 0 else [])) for i in range(120)]
    toxic = [int(("wax" in t or "wbcx" in t or "wddx" in t) != (rng.random() < 0.1)) for t in texts]
    kinds = [["women", "men", "people"]]
    weight = {0: 1.0, 1: 1.5}
    l1, l2, fairness = 2e-3, 1e-2, 1.0
    model = toxicity.fit_texts(texts, toxic, weight, kinds, l1=l1, l2=l2, fairness=fairness, rounds=20_000, tolerance=1e-12)
    rows = [toxicity.text_features(t) for t in texts]
    swaps = [c for t in texts if (c := toxicity.changes(t, kinds))] + toxicity.mentions(kinds)
    columns = sorted({c for r in rows for c in r})
    dense = lambda some: np.array([[r.get(c, 0) for c in columns] for r in some], float)
    x, d, y = dense(rows), dense(swaps), np.array(toxic, float)
    scale = np.maximum(np.sqrt((x**2).mean(0)), 0.5)
    x, d = ((v.astype(np.float32) / scale).astype(np.float32).astype(float) for v in (x, d))  # cells are held as float32
    k = np.array([weight[t] for t in toxic])
    k /= k.sum()
    lipschitz = 0.25 * np.linalg.norm((np.c_[x, np.ones(len(x))].T * k) @ np.c_[x, np.ones(len(x))], 2) + l2 + 2 * fairness / len(d) * np.linalg.norm(d.T @ d, 2)
    w, b = np.zeros(len(columns)), 0.0
    for _ in range(160_000):
        r = k * (1 / (1 + np.exp(-(x @ w + b))) - y)
        w = w - (x.T @ r + l2 * w + 2 * fairness / len(d) * d.T @ (d @ w)) / lipschitz
        w, b = np.sign(w) * np.maximum(np.abs(w) - l1 / lipschitz, 0), b - r.sum() / lipschitz
    want = 1 / (1 + np.exp(-(x @ w + b)))
    logits = np.array([model.intercept + sum(model.weights.get(c, 0.0) * v for c, v in r.items()) for r in rows])
    assert 1 / (1 + np.exp(-logits)) == pytest.approx(want, abs=1e-6) and 3 < np.count_nonzero(w) < len(columns)
