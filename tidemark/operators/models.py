"""Many small models fitted in the same passes: k-means of several sizes and starts, logistic regressions of several folds.

An iteration is one aggregation whatever the number of models: every task adds up what each model needs of its rows
(sums by centre; gradient and Hessian), the tasks' sums meet by model, and a few numbers a model reach the driver, which moves the
models on. Models that have settled drop out. Jobs grow with iterations and not with models.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are compared with all centres at a time.
ROWS = 2048


def summed(rows: DataFrame, per_batch: Callable[[pa.RecordBatch], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """The sum over all rows of what ``per_batch`` gives for each model (flat arrays), by one job."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for model, value in per_batch(b).items():
                held[model] = held[model] + value if model in held else value
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["model", "held"])

    def meet(part: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(v) for v in part["held"].to_pylist()], axis=0)
        return pa.table({"model": part["model"][:1], "held": pa.array([total.tobytes()], pa.binary())})

    parts = rows.mapInArrow(add, "model long, held binary").groupBy("model").applyInArrow(meet, "model long, held binary")
    return {r["model"]: np.frombuffer(r["held"]) for r in parts.collect()}  # a row a model


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists of numbers."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


@dataclass
class Centres:
    places: np.ndarray
    inertia: float = np.inf
    rounds: int = 0
    settled: bool = False


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centre and the squared distance to it."""
    place = np.empty(len(x), np.int64)
    norms = (centres**2).sum(1)
    for lo in range(0, len(x), ROWS):
        place[lo : lo + ROWS] = (norms - 2 * (x[lo : lo + ROWS] @ centres.T)).argmin(1)
    return place, ((x - centres[place]) ** 2).sum(1)


def spread_out(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` rows of a sample, each drawn by its squared distance to those before (Arthur and Vassilvitskii 2007)."""
    chosen = [sample[rng.integers(len(sample))]]
    away = ((sample - chosen[0]) ** 2).sum(1)
    for _ in range(k - 1):
        total = away.sum()
        chosen.append(sample[rng.choice(len(sample), p=away / total) if total > 0 else rng.integers(len(sample))])
        away = np.minimum(away, ((sample - chosen[-1]) ** 2).sum(1))
    return np.array(chosen)


def kmeans(rows: DataFrame, features: str, sizes: Sequence[int], starts: int = 10, seed: int = 42, most_rounds: int = 300, tolerance: float = 1e-4, sample: int = 4096) -> dict[tuple[int, int], Centres]:
    """Models by (k, start), all by Lloyd's steps side by side. ``features`` is an array column; rows without it don't count.

    Starts are drawn from a sample of ``sample`` rows (the first by their hash); everything else is from all rows. A model has settled when its
    centres move by ``tolerance`` times the mean variance of a feature, or less. Centres that lose all rows stay.
    """
    known = rows.where(F.col(features).isNotNull()).select(F.transform(features, lambda v: v.cast("double")).alias("x"))
    some = known.orderBy(F.xxhash64("x"), "x").limit(sample).collect()
    if not some:
        return {}
    drawn = np.array([r["x"] for r in some], np.float64)
    names = [(k, s) for k in sizes for s in range(starts)]
    models = {n: Centres(spread_out(drawn, n[0], np.random.default_rng([seed, *n]))) for n in names}
    d = drawn.shape[1]
    scale = None
    for _ in range(most_rounds + 1):
        active = [(i, n) for i, n in enumerate(names) if not models[n].settled]
        if not active:
            break
        centres = {i: models[n].places for i, n in active}
        every = np.concatenate(list(centres.values()))
        lengths = (every**2).sum(1)[:, None]
        first = scale is None

        def per_batch(b: pa.RecordBatch, centres: dict = centres, every: np.ndarray = every, lengths: np.ndarray = lengths, first: bool = first) -> dict[int, np.ndarray]:
            x, out = matrix(b.column(0)), {}
            for lo in range(0, len(x), ROWS):
                part = x[lo : lo + ROWS]
                # one product with the centres of all models; then each row's place among a model's
                far = every @ part.T
                far *= -2
                far += lengths
                at, squares = 0, float((part**2).sum())
                for i, c in centres.items():
                    own = far[at : at + len(c)]
                    at += len(c)
                    chosen = (own == own.min(0)).astype(np.float64)
                    if (n := chosen.sum(1)).sum() > len(part):  # a row has its first nearest centre only
                        chosen *= np.cumsum(chosen, axis=0) == 1
                        n = chosen.sum(1)
                    norms, sums = (c**2).sum(1), chosen @ part
                    # |x - c|^2 summed over a centre's rows, from their sums
                    away = squares + float((n * norms).sum() - 2 * (sums * c).sum())
                    out[i] = out.get(i, 0) + np.concatenate([n, sums.ravel(), [max(0.0, away)]])
            if first:
                out[-1] = np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)])
            return out

        found = summed(known, per_batch)
        if first:
            n, total, squares = found[-1][0], found[-1][1 : 1 + d], found[-1][1 + d :]
            scale = float(np.mean(np.maximum(squares / n - (total / n) ** 2, 0)))
        for i, name in active:
            m, k = models[name], name[0]
            count, sums = found[i][:k], found[i][k:-1].reshape(k, d)
            m.inertia, m.rounds = float(found[i][-1]), m.rounds + 1
            moved = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], m.places)
            shift = float(((moved - m.places) ** 2).sum())
            # the inertia is that of the centres it was taken with, so those stay once they hardly move
            m.settled = shift <= tolerance * scale or m.rounds > most_rounds
            if not m.settled:
                m.places = moved
    return models


def best(models: dict[tuple[int, int], Centres], k: int) -> Centres:
    """The start of least inertia, the first of equals."""
    return min((m for (size, _), m in sorted(models.items(), key=lambda item: item[0]) if size == k), key=lambda m: m.inertia)


def assigned(rows: DataFrame, features: str, model: Centres, to: str = "cluster") -> DataFrame:
    """``rows`` and the number of their nearest centre; null without features."""
    names = [f.name for f in rows.schema]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    centres = model.places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(names.index(features))
            here = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            place: list = [None] * b.num_rows
            if len(here):
                for i, c in zip(here.tolist(), nearest(matrix(column.take(pa.array(here))), centres)[0].tolist(), strict=True):
                    place[i] = c
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place, pa.int32())], names=[*names, to])

    return rows.mapInArrow(run, f"{fields}, `{to}` int")


@dataclass
class Fold:
    """A logistic regression on standardised features; ``beta`` ends with the intercept."""

    mean: np.ndarray
    scale: np.ndarray
    weights: tuple[float, float]
    beta: np.ndarray
    before: np.ndarray | None = None
    loss: float = np.inf
    rounds: int = 0
    settled: bool = False
    path: list[float] = field(default_factory=list)

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.divide(x - self.mean, self.scale, out=np.zeros_like(x), where=self.scale > 0)
        return np.concatenate([z, np.ones((len(x), 1))], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(x) @ self.beta, -700, 700)))


def group_folds(rows: DataFrame, vector: str, label: str, group: str, c: float = 0.1, most_rounds: int = 100, tolerance: float = 1e-9) -> dict:
    """By group, the logistic regression (balanced weights, ridge 1 / c, intercept free) on the rows of all other groups; groups
    whose training rows have one class have none.

    All folds take Newton's steps together; one that would raise its loss is halved. Means, deviations (of n - 1) and class weights of a
    fold are the totals less the group's own. Groups are few (sessions): d * d numbers of each reach the driver.
    """
    known = rows.where(F.col(vector).isNotNull() & F.col(label).isNotNull() & F.col(group).isNotNull())
    known = known.select(F.col(group).alias("g"), F.transform(vector, lambda v: v.cast("double")).alias("x"), F.col(label).cast("double").alias("y"))
    groups = sorted(r[0] for r in known.select("g").distinct().collect())
    number = {g: i for i, g in enumerate(groups)}

    def moments(b: pa.RecordBatch) -> dict[int, np.ndarray]:
        g, x, y = np.array([number[v] for v in b.column(0).to_pylist()]), matrix(b.column(1)), b.column(2).to_numpy()
        return {int(i): np.concatenate([[m.sum(), y[m].sum()], x[m].sum(0), (x[m] ** 2).sum(0)]) for i in np.unique(g) for m in [g == i]}

    found = summed(known, moments)
    if not found:
        return {}
    total = np.sum(list(found.values()), axis=0)
    folds: dict[int, Fold] = {}
    for i in range(len(groups)):
        n, positive, *_ = rest = total - found[i]
        d = (len(rest) - 2) // 2
        if min(positive, n - positive) < 0.5:
            continue
        mean = rest[2 : 2 + d] / n
        deviation = np.sqrt(np.maximum(rest[2 + d :] - n * mean**2, 0) / max(1.0, n - 1))
        deviation[deviation < 1e-12 * np.maximum(1, np.abs(mean))] = 0
        folds[i] = Fold(mean, deviation, (n / (2 * (n - positive)), n / (2 * positive)), np.zeros(d + 1))
    for _ in range(most_rounds):
        active = {i: f for i, f in folds.items() if not f.settled}
        if not active:
            break

        def step(b: pa.RecordBatch, active: dict = active) -> dict[int, np.ndarray]:
            g, x, y = np.array([number[v] for v in b.column(0).to_pylist()]), matrix(b.column(1)), b.column(2).to_numpy()
            out = {}
            for i, f in active.items():
                m = g != i
                z, t = f.inputs(x[m]), y[m]
                w, eta = np.where(t > 0, f.weights[1], f.weights[0]), f.inputs(x[m]) @ f.beta
                p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                loss = (w * (np.logaddexp(0, eta) - t * eta)).sum()
                out[i] = np.concatenate([[loss], z.T @ (w * (p - t)), ((z * (w * p * (1 - p))[:, None]).T @ z).ravel()])
            return out

        for i, held in summed(known, step).items():
            f = folds[i]
            d = len(f.beta)
            ridge = np.full(d, 1 / c)
            ridge[-1] = 0
            loss, slope = held[0] + 0.5 * (ridge * f.beta**2).sum(), held[1 : 1 + d] + ridge * f.beta
            curve = held[1 + d :].reshape(d, d) + np.diag(ridge)
            f.rounds += 1
            if f.before is not None and loss > f.loss + 1e-12 * abs(f.loss):
                f.beta = (f.beta + f.before) / 2
                f.settled = bool(np.abs(f.beta - f.before).max() < tolerance)
                continue
            f.loss, f.before = float(loss), f.beta
            f.path.append(f.loss)
            move = np.linalg.solve(curve, slope)
            f.beta = f.beta - move
            f.settled = bool(np.abs(move).max() < tolerance)
    return {groups[i]: f for i, f in folds.items()}


def fold_scores(rows: DataFrame, folds: dict, vector: str, label: str, group: str) -> DataFrame:
    """``group, truth, score`` of the rows of groups that have a fold, each by the model that left its group out."""
    kind, truth = dict(rows.dtypes)[group], dict(rows.dtypes)[label]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).to_pylist()
            keep = [i for i, g in enumerate(names) if g in folds]
            some, x, score = b.take(pa.array(keep, pa.int64())), None, np.zeros(len(keep))
            if keep:
                x, of = matrix(some.column(2)), [names[i] for i in keep]
                for g in set(of):
                    mine = np.array([o == g for o in of])
                    score[mine] = folds[g].score(x[mine])
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(score)], names=["group", "truth", "score"])

    known = rows.where(F.col(vector).isNotNull()).select(group, label, F.transform(vector, lambda v: v.cast("double")))
    return known.mapInArrow(run, f"`group` {kind}, truth {truth}, score double")
