"""Moving foreground of fixed cameras: a Gaussian mixture per pixel, cleaned masks and their blobs.

The mixture (Stauffer and Grimson 1999; weights, means and variances updated as by Zivkovic 2004) remembers what each pixel
usually shows. Masks of what it doesn't explain are opened and closed by round kernels, then cut into 8-connected blobs by a
union-find over the runs of their rows. A camera's frames follow one another, so a video is one ordered run of rows in its
task; rows stream by and only the model is held. ``streaming.foreground`` carries the same model over micro-batches.

Frames are flat arrays of grey pixels (0-255), ``width`` to a row; null pixels count as 0. A frame of another size, or one more than
``idle`` after the one before it, begins a new model. Rows without pixels, and frames darker than ``bright`` on average, have
no foreground and leave the model as it is, unless ``learn_dark``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

RESULT = "foreground double, n_blobs long, largest double, band double"


@dataclass(frozen=True)
class Settings:
    """``history``: frames after which the model learns at a constant rate. ``variance``: squared distance from a component, in
    its variances, up to which background reaches; ``own``: up to which a component takes a pixel for its own."""

    width: int
    history: int = 200
    variance: float = 40.0
    own: float = 9.0
    components: int = 5
    first_variance: float = 15.0
    least_variance: float = 4.0
    most_variance: float = 75.0
    background: float = 0.9
    opened: int = 5
    closed: int = 15
    low: float = 0.0
    high: float = 1.0
    bright: float = 0.0
    learn_dark: bool = False
    idle: int | None = None


class Mixture:
    """Components of all pixels, heaviest first: ``weight, mean, spread`` of shape (components, pixels)."""

    def __init__(self, settings: Settings, pixels: int):
        self.settings, self.seen = settings, 0
        self.weight, self.mean = np.zeros((settings.components, pixels)), np.zeros((settings.components, pixels))
        self.spread = np.full((settings.components, pixels), settings.first_variance)

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Which pixels of a frame no background component explains; the frame then enters the model."""
        s = self.settings
        away = (x - self.mean) ** 2
        in_use = self.weight > 0
        # the heaviest components that make up the background
        holds = in_use & (np.cumsum(self.weight, axis=0) - self.weight < s.background)
        odd = ~(holds & (away < s.variance * self.spread)).any(axis=0)
        self.seen += 1
        rate = 1 / min(self.seen, s.history)
        fits = in_use & (away < s.own * self.spread)
        first = fits & (np.cumsum(fits, axis=0) == 1)
        self.weight = (1 - rate) * self.weight + rate * first
        step = np.where(first, rate / np.where(first, self.weight, 1), 0)
        self.mean += step * (x - self.mean)
        self.spread = np.where(first, np.clip(self.spread + step * (away - self.spread), s.least_variance, s.most_variance), self.spread)
        new = ~fits.any(axis=0)
        self.weight[-1, new], self.mean[-1, new], self.spread[-1, new] = rate, x[new], s.first_variance
        self.weight /= self.weight.sum(axis=0)
        order = np.argsort(-self.weight, axis=0, kind="stable")
        self.weight, self.mean, self.spread = (np.take_along_axis(v, order, axis=0) for v in (self.weight, self.mean, self.spread))
        return odd if self.seen > 1 else np.zeros(len(x), bool)

    def to_bytes(self) -> bytes:
        return np.stack([self.weight, self.mean, self.spread]).tobytes()

    @classmethod
    def from_bytes(cls, settings: Settings, data: bytes, seen: int) -> Mixture:
        held = np.frombuffer(data).reshape(3, settings.components, -1).copy()
        model = cls(settings, held.shape[2])
        (model.weight, model.mean, model.spread), model.seen = held, seen
        return model


def kernel(size: int) -> list[tuple[int, int]]:
    """Offsets (row, column) of a filled ellipse in a square of odd size."""
    r = size // 2
    return [(i, j) for i in range(-r, r + 1) for j in range(-r, r + 1) if abs(j) <= (round(r * np.sqrt(1 - (i / r) ** 2)) if r else 0)]


def _shifted(mask: np.ndarray, size: int, outside: bool) -> Iterator[np.ndarray]:
    r, (h, w) = size // 2, mask.shape
    padded = np.pad(mask, r, constant_values=outside)
    for i, j in kernel(size):
        yield padded[r + i : r + i + h, r + j : r + j + w]


def eroded(mask: np.ndarray, size: int) -> np.ndarray:
    return np.logical_and.reduce(list(_shifted(mask, size, True)))


def dilated(mask: np.ndarray, size: int) -> np.ndarray:
    return np.logical_or.reduce(list(_shifted(mask, size, False)))


def cleaned(mask: np.ndarray, opened: int, closed: int) -> np.ndarray:
    """Opened, which removes specks, then closed, which fills gaps. Pixels beyond the border decide nothing."""
    return eroded(dilated(dilated(eroded(mask, opened), opened), closed), closed)


def blobs(mask: np.ndarray) -> np.ndarray:
    """Areas of the 8-connected blobs of a mask, in the order of their first pixels."""
    h, w = mask.shape
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edges == 1)
    last = np.nonzero(edges == -1)[1]  # one past the run
    top = list(range(len(row)))

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    begins = np.searchsorted(row, np.arange(h + 1)).tolist()
    for r in range(1, h):
        a, b = begins[r - 1], begins[r]
        while a < begins[r] and b < begins[r + 1]:
            if first[a] <= last[b] and first[b] <= last[a]:
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
            if last[a] < last[b]:
                a += 1
            else:
                b += 1
    roots = np.array([root(i) for i in range(len(row))], np.int64)
    areas = np.bincount(roots, weights=last - first, minlength=len(row)).astype(np.int64)
    return areas[areas > 0]


class Scene:
    """One camera's model, fed with frames in their order."""

    def __init__(self, settings: Settings):
        self.settings, self.model, self.last = settings, None, None

    def frame(self, at: int, pixels) -> tuple[float, int, float, float]:
        s = self.settings
        x = np.nan_to_num(np.asarray([] if pixels is None else pixels, np.float64))
        if s.idle is not None and self.last is not None and at - self.last > s.idle:
            self.model = None
        self.last = at
        dark = len(x) == 0 or x.mean() < s.bright
        if dark and (len(x) == 0 or not s.learn_dark):
            return 0.0, 0, 0.0, 0.0
        if self.model is None or self.model.mean.shape[1] != len(x):
            self.model = Mixture(s, len(x))
        odd = self.model.apply(x)
        if dark:
            return 0.0, 0, 0.0, 0.0
        mask = np.pad(odd, (0, -len(x) % s.width)).reshape(-1, s.width)
        shares = blobs(cleaned(mask, s.opened, s.closed)) / len(x)
        inside = shares[(shares >= s.low) & (shares <= s.high)]
        return float(odd.mean()), len(shares), float(shares.max(initial=0.0)), float(inside.max(initial=0.0) / s.high)


def foreground(frames: DataFrame, settings: Settings, key: str = "video", t: str = "us", pixels: str = "pixels", tie: str = "event_id") -> DataFrame:
    """``key, t, tie, foreground`` (the share of pixels that the background doesn't explain), ``n_blobs``, ``largest`` (the largest
    blob's share of the frame) and ``band`` (the largest share from ``low`` to ``high``, over ``high``)."""
    kinds = dict(frames.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, scene = None, None
        for b in batches:
            rows = []
            for k, at, p in zip(b[key], b[t], b[pixels], strict=True):
                if scene is None or (k != current and not (pd.isna(k) and pd.isna(current))):
                    current, scene = k, Scene(settings)
                rows.append(scene.frame(at, p))
            yield pd.concat([b[[key, t, tie]].reset_index(drop=True), pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])], axis=1)

    ordered = frames.select(key, t, tie, pixels).repartition(key).sortWithinPartitions(key, t, tie)
    return ordered.mapInPandas(run, f"`{key}` {kinds[key]}, `{t}` {kinds[t]}, `{tie}` {kinds[tie]}, {RESULT}")


def blob_shares(frames: DataFrame, width: int, level: float, pixels: str = "pixels") -> DataFrame:
    """``frames`` without their pixels, and ``blobs``: the blobs' shares of the frame, where pixels are above ``level``, in the
    order of their first pixels; empty for frames without pixels. Null pixels are below any level."""
    kept = [f for f in frames.schema if f.name != pixels]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for p in b.column(b.num_columns - 1).to_pylist():
                x = np.array([np.nan if v is None else v for v in p or []], np.float64)
                mask = np.pad(x > level, (0, -len(x) % width)).reshape(-1, width)
                found.append((blobs(mask) / max(1, len(x))).tolist() if len(x) else [])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.list_(pa.float64()))], names=[*b.schema.names[:-1], "blobs"])

    return frames.select(*(f.name for f in kept), pixels).mapInArrow(run, f"{fields}, blobs array<double>")
