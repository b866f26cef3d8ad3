"""A counterfactual-regularised toxicity classifier.

Features of a text are counts over its distinct words: each word and its first 3 to 6 letters, hashed into
``BUCKETS`` columns, so none is left out; columns that no labelled text has keep no weight, as the loss asks. A logistic model with an L1 term is fitted to labelled texts. For every
labelled text that names a group of people the identity terms are swapped for others of their kind, and the
squared change of the score's logit is part of the loss. Labelled texts may name few groups or none; so every
term of the list also stands for a neutral mention added to a labelled sentence: swapping it for the next of its
kind changes that text by the features of the two words alone, and these changes are penalised alike. Each kind
ends in a word for people at large, so a kind isn't heavier as a whole either. The mentions carry no labels. Terms whose
features no labelled text shares have no weight to begin with: for them the penalty has nothing to do.

The fit runs on a bounded sample of labelled rows: ``per_class`` of either label at most, those of the least
hashed id, as long as they have ``most_cells`` feature counts together, those of swapped texts included; class weights restore the shares of all
labelled rows. Tasks make the feature rows; texts don't reach the driver. Scoring covers every document in one
narrow pass.

Cases: null and empty texts get the intercept's score; null labels or ids don't count; an id with several
labels counts as toxic if one of them is; of several texts of an id the least is learnt from; with labels of one class
alone every text gets that class's share; without labels the score is 0; repeated rows give repeated results; other
columns are neither read nor needed, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, materialize, released, remove, text_or_empty

# Identity terms that stand for one another, by kind; the last of each names people at large.
IDENTITY_TERMS = [
    ["women", "men", "people"],
    ["woman", "man", "person"],
    ["girls", "boys", "children"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "atheists", "believers"],
    ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "human"],
    ["black", "white", "asian", "latino", "indigenous", "human"],
    ["gay", "lesbian", "bisexual", "straight", "transgender", "human"],
    ["immigrants", "refugees", "locals", "citizens", "people"],
    ["american", "chinese", "indian", "mexican", "french", "german", "spanish", "russian", "nigerian", "foreign"],
    ["blind", "deaf", "disabled", "elderly", "young", "human"],
    ["frauen", "männer", "menschen"],
    ["christen", "muslime", "juden", "hindus", "leute"],
    ["ausländer", "flüchtlinge", "einheimische", "leute"],
    ["femmes", "hommes", "gens"],
    ["chrétiens", "musulmans", "juifs", "hindous", "gens"],
    ["étrangers", "réfugiés", "habitants", "gens"],
    ["mujeres", "hombres", "gente"],
    ["cristianos", "musulmanes", "judíos", "hindúes", "gente"],
    ["extranjeros", "refugiados", "vecinos", "gente"],
]

LETTERS = re.compile(r"[^\W\d_]+")
#: Columns that features are hashed into.
BUCKETS = 1 << 20


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) % BUCKETS


def word_features(word: str) -> list[int]:
    """The columns of one white-space-separated, lower-cased word."""
    out = []
    for w in LETTERS.findall(word):
        out.append(bucket("=" + w))
        out += [bucket(w[:k]) for k in (3, 4, 5, 6) if len(w) >= k]
    return out


def swap_terms(text: str, terms: list[list[str]] = IDENTITY_TERMS) -> str:
    """The lower-cased text with every identity term replaced by the next of its kind (the first that lists it)."""
    after: dict[str, str] = {}
    for kind in terms:
        for k, w in enumerate(kind[:-1]):
            after.setdefault(w, kind[k + 1])
    return LETTERS.sub(lambda m: after.get(m[0], m[0]), text.lower())


def text_features(text: str) -> Counter:
    return Counter(f for w in set(text.lower().split()) for f in word_features(w))


def changes(text: str, terms: list[list[str]] = IDENTITY_TERMS) -> Counter:
    """What swapping a text's identity terms changes of its features."""
    out = text_features(text)
    out.subtract(text_features(swap_terms(text, terms)))
    return Counter({f: v for f, v in out.items() if v})


def mentions(terms: list[list[str]] = IDENTITY_TERMS) -> list[Counter]:
    """What swapping the one term of an added neutral mention changes, for every term but the last of a kind."""
    return [c for kind in terms for w in kind[:-1] if (c := changes(w, terms))]


@dataclass
class ToxicityModel:
    """Weights by column; ``counterfactuals`` counts the swapped texts and mentions of the penalty."""

    intercept: float = -math.inf
    weights: dict[int, float] = field(default_factory=dict)
    counterfactuals: tuple[int, int] = (0, 0)

    def word_weight(self, word: str) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in word_features(word))


class SparseRows:
    """Rows of (column, value) cells, held by row and by column, for products with vectors."""

    def __init__(self, sizes: np.ndarray, column: np.ndarray, value: np.ndarray, width: int):
        self.shape = len(sizes), width
        self.column, self.value = column.astype(np.int32), value.astype(np.float32)
        self.row_at, self.row_start = self._starts(np.asarray(sizes, np.int64))
        order = np.argsort(self.column, kind="stable")
        self.by_row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        self.by_value = self.value[order]
        self.column_at, self.column_start = self._starts(np.bincount(self.column, minlength=width))

    @staticmethod
    def _starts(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(sizes)
        return at, (np.cumsum(sizes) - sizes)[at]

    @staticmethod
    def _sums(cells: np.ndarray, at: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n)
        if len(at):
            out[at] = np.add.reduceat(cells, start)
        return out

    def spread(self, least: float) -> np.ndarray:
        """Root mean squares of the columns, ``least`` at least."""
        squares = self._sums(self.by_value.astype(np.float64) ** 2, self.column_at, self.column_start, self.shape[1])
        return np.maximum(np.sqrt(squares / max(1, self.shape[0])), least)

    def scale(self, spread: np.ndarray) -> None:
        """Divides every column by its ``spread``; the order of the cells stays, so nothing is sorted again."""
        n = np.diff(np.append(self.column_start, len(self.by_value)))
        self.value = (self.value / spread[self.column]).astype(np.float32)
        self.by_value = (self.by_value / np.repeat(spread[self.column_at], n)).astype(np.float32)

    def times(self, w: np.ndarray) -> np.ndarray:
        return self._sums(self.value * w[self.column], self.row_at, self.row_start, self.shape[0])

    def back(self, r: np.ndarray) -> np.ndarray:
        return self._sums(self.by_value * r[self.by_row], self.column_at, self.column_start, self.shape[1])


def gradient(x: SparseRows, swaps: SparseRows, y: np.ndarray, weight: np.ndarray, w: np.ndarray, b: float, fairness: float, l2: float) -> tuple[np.ndarray, float]:
    """Of the weighted log loss, ``l2 / 2 * |w|^2`` and ``fairness`` times the mean squared change of a logit."""
    r = weight * (1 / (1 + np.exp(-np.clip(x.times(w) + b, -40, 40))) - y)
    g = x.back(r) + l2 * w
    if swaps.shape[0]:
        g += 2 * fairness / swaps.shape[0] * swaps.back(swaps.times(w))
    return g, float(r.sum())


Cells = tuple[np.ndarray, np.ndarray, np.ndarray]  # sizes of rows, columns, values


def cells(rows: list[Counter]) -> Cells:
    return np.array([len(r) for r in rows], np.int64), np.array([f for r in rows for f in r], np.int32), np.array([v for r in rows for v in r.values()], np.float32)


def _joined(a: Cells, b: Cells) -> Cells:
    return tuple(np.concatenate(p) for p in zip(a, b, strict=True))


def fit_rows(texts: Cells, swapped: Cells, toxic: np.ndarray, class_weight: dict[int, float], fairness: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, rounds: int = 300, tolerance: float = 1e-6, least_spread: float = 0.5, terms: list[list[str]] = IDENTITY_TERMS) -> ToxicityModel:
    """The model of labelled feature rows; ``swapped``: the changes of those that name groups. Deterministic for
    a given order of rows. Columns are scaled to one root mean square, rare ones to ``least_spread`` of it at most, so that they don't shorten
    the steps. Steps end when no weight moves by ``tolerance`` of the largest, or after ``rounds``."""
    y = np.asarray(toxic, np.float64)
    if not len(y):
        return ToxicityModel()
    weight = np.where(y > 0, class_weight.get(1, 1.0), class_weight.get(0, 1.0))
    share = float((weight * y).sum() / weight.sum())
    if share in (0.0, 1.0):
        return ToxicityModel(math.inf if share else -math.inf)
    named = cells(mentions(terms))
    counted = len(swapped[0]), len(named[0])
    swapped = _joined(swapped, named)
    used = np.flatnonzero(np.bincount(texts[1], minlength=BUCKETS))
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)

    def kept(rows: Cells) -> Cells:
        at = place[rows[1]]
        ok = at >= 0
        row = np.repeat(np.arange(len(rows[0]), dtype=np.int32), rows[0])[ok]
        return np.bincount(row, minlength=len(rows[0])), at[ok], rows[2][ok]

    size, column, value = kept(texts)
    del texts
    if not len(used):
        return ToxicityModel(math.log(share / (1 - share)), {}, counted)
    # columns of one scale: few rounds suffice, and the L1 term treats them alike
    x = SparseRows(size, column, value, len(used))
    spread = x.spread(least_spread)
    x.scale(spread)
    swaps = SparseRows(*kept(swapped), len(used))
    swaps.scale(spread)
    del size, column, value, swapped
    weight = weight / weight.sum()
    # the step is the inverse of the curvature's bound, found by power iteration
    v, vb, bound = np.ones(len(used)) / math.sqrt(len(used)), 1.0, 1.0
    for _ in range(20):
        q = x.times(v) + vb
        u, ub = 0.25 * x.back(weight * q) + l2 * v, 0.25 * float((weight * q).sum())
        u = u + 2 * fairness / max(1, swaps.shape[0]) * swaps.back(swaps.times(v))
        bound = math.sqrt(float(u @ u) + ub * ub)
        v, vb = u / bound, ub / bound
    step = 1 / (1.1 * bound)
    w, b = np.zeros(len(used)), math.log(share / (1 - share))
    zw, zb, momentum = w, b, 1.0
    for _ in range(rounds):
        g, gb = gradient(x, swaps, y, weight, zw, zb, fairness, l2)
        new = zw - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        nb = zb - step * gb
        moved = max(float(np.abs(new - w).max()), abs(nb - b))
        if float((zw - new) @ (new - w)) + (zb - nb) * (nb - b) > 0:
            momentum = 1.0  # the momentum led uphill: begin again from here
        after = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        zw, zb = new + (momentum - 1) / after * (new - w), nb + (momentum - 1) / after * (nb - b)
        w, b, momentum = new, nb, after
        if moved <= tolerance * max(1e-3, float(np.abs(w).max())):
            break
    weights = {int(n): float(c) for n, c in zip(used, w / spread, strict=True) if c}
    return ToxicityModel(b, weights, counted)


def fit_texts(texts: list[str], toxic: list[int], class_weight: dict[int, float], terms: list[list[str]] = IDENTITY_TERMS, **options) -> ToxicityModel:
    """The model of labelled texts at hand."""
    swapped = [c for t in texts if (c := changes(t, terms))]
    return fit_rows(cells([text_features(t) for t in texts]), cells(swapped), np.array(toxic), class_weight, terms=terms, **options)


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether a row's label is kept from training: crc32 of the id as text; null ids aren't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def feature_rows(texts: DataFrame, terms: list[list[str]] = IDENTITY_TERMS) -> DataFrame:
    """``__id, columns, counts, swap_columns, swap_counts`` of every ``__id, __text``."""
    kind = texts.schema["__id"].dataType.simpleString()
    lists = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for b in batches:
            for k in range(b.num_rows):  # a row at a time: one may be very long
                text = b.column(1)[k].as_py()
                words = set(text.lower().split())
                for w in words.difference(known):
                    known[w] = word_features(w)
                found, swap = Counter(f for w in words for f in known[w]), changes(text, terms)
                rows = [list(found), list(found.values()), list(swap), list(swap.values())]
                if len(known) > CACHE_ENTRIES:
                    known.clear()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), *(pa.array([r], lists) for r in rows)], names=["__id", "columns", "counts", "swap_columns", "swap_counts"])

    return texts.select("__id", "__text").mapInArrow(released(run), f"__id {kind}, columns array<int>, counts array<int>, swap_columns array<int>, swap_counts array<int>")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, most_cells: int = 12_000_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", terms: list[list[str]] = IDENTITY_TERMS, **options) -> ToxicityModel:
    """Fits to the labelled documents outside the held-out fold: at most ``per_class`` of either label, and of
    these as many, by hashed id, as have ``most_cells`` feature counts (8 bytes each in the driver) together."""
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("__id")).agg((F.max(label_col) > 0).cast("int").alias("__toxic"))
    total = {r["__toxic"]: r["count"] for r in known.groupBy("__toxic").count().collect()}
    chosen = [r for t in (0, 1) for r in known.where(F.col("__toxic") == t).orderBy(F.xxhash64("__id"), "__id").limit(per_class).collect()]
    if not chosen:
        return ToxicityModel()
    toxic = dict((r[0], r[1]) for r in chosen)
    wanted = spark.createDataFrame(chosen, known.schema)  # 2 * per_class rows at most
    texts = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text")).join(F.broadcast(wanted), "__id").groupBy("__id").agg(F.min("__text").alias("__text"))
    rows, path = materialize(feature_rows(texts, terms), "toxicity-features")
    before = F.sum(F.size("columns") + F.size("swap_columns")).over(Window.orderBy(F.xxhash64("__id"), "__id").rowsBetween(Window.unboundedPreceding, -1))  # 2 * per_class rows at most
    fits = rows.select("__id", F.coalesce(before, F.lit(0)).alias("__before")).where(F.col("__before") <= most_cells).select("__id")
    got = rows.join(F.broadcast(fits), "__id").orderBy("__id").toArrow().combine_chunks()
    remove(spark, path)
    if not got.num_rows:
        return ToxicityModel()

    def taken(columns: str, counts: str) -> Cells:
        c, v = got.column(columns).combine_chunks(), got.column(counts).combine_chunks()
        size = c.value_lengths().to_numpy()
        return size[size > 0] if columns != "columns" else size, c.flatten().to_numpy(), v.flatten().to_numpy().astype(np.float32)

    y = [toxic[i] for i in got.column("__id").to_pylist()]
    drawn = Counter(y)
    parts = [taken("columns", "counts"), taken("swap_columns", "swap_counts")]
    del got
    return fit_rows(parts.pop(0), parts.pop(), np.array(y), {t: total[t] / n for t, n in drawn.items()}, terms=terms, **options)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score, predicted`` for every whole text. One narrow pass."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for b in batches:
            out = []
            for t in b.column(1):
                words = set(t.as_py().lower().split())
                for w in words.difference(known):
                    known[w] = model.word_weight(w)
                out.append(model.intercept + math.fsum(map(known.__getitem__, words)))
                if len(known) > CACHE_ENTRIES:
                    known.clear()
            s = 1 / (1 + np.exp(-np.clip(np.array(out, np.float64), -700, 700)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    return docs.select(id_col, text_or_empty(text_col)).mapInArrow(released(run), f"`{id_col}` {kind}, score double, predicted int")


def reject(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The documents whose score is below the threshold, with all their columns."""
    names, schema = docs.columns, docs.schema
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        limit = math.log(threshold / (1 - threshold))
        for b in batches:
            keep = []
            for t in b.column(at):
                words = set((t.as_py() or "").lower().split())
                for w in words.difference(known):
                    known[w] = model.word_weight(w)
                keep.append(model.intercept + math.fsum(map(known.__getitem__, words)) < limit)
                if len(known) > CACHE_ENTRIES:
                    known.clear()
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(released(run), schema)
