"""Density clustering of all vectors together: HDBSCAN (Campello, Moulavi and Sander 2013), exact, over blocks of vectors.

Vectors are dealt to the nearest of a few pivots, and a pivot's cell into blocks of ``block`` rows. A block meets those cells only
that can still matter by the triangle inequality: for core distances, cells nearer than the neighbours already known; for
the spanning tree, cells nearer than the best edge already known of a component. Blocks are dealt into groups, and a task compares
two groups' blocks, each pair once for both sides: a block is sent as often as there are groups, not as often as it meets
others. Tasks give back minima, or a vector's few nearest; no other pair of vectors is ever a row.

Pairs are compared by a matrix product, whose squares are off by a known slack at most. It only rules pairs out: what is
left (a few pairs a vector) is measured by ``distances``' own arithmetic, so results don't depend on blocks.

The minimum spanning tree of mutual reachability grows by rounds (Boruvka 1926): each component takes its least edge, in the
total order (length, smaller key, larger key). The nearest that were found for core distances, ``LISTED`` a vector, are looked at first; an
edge that neither end lists is no shorter than the farthest that either lists, so blocks compare only those vectors whose lists end
within the best edge already known of their component (or of one they meet). Then pointers to the component at the other end are doubled until all name their
roots. Rounds are no more than the logarithm of the number of vectors; each ends in a written table.

The condensed tree is one ordered pass over the tree's edges, an edge a vector: the one step that is a single task, which
holds a few numbers a vector (about 100 bytes) and no vectors.

Keys are whole numbers, each on one row. Rows without a vector or key are noise (-1), and all rows are if there are no more than
``least``. Equal vectors are at distance 0. Pivots are a sample and steer only which blocks meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize, remove

#: Differences between vectors that are held at a time.
CELLS = 1 << 21
#: Groups of blocks, at least, and vectors of a group: a task holds two groups.
LEAST_GROUPS, GROUP_ROWS = 12, 1 << 14
#: Nearest others that are kept of a vector.
LISTED = 16
NEAREST = "id long, found array<struct<d:double,m:long>>"
EDGE = "comp long, w double, a long, b long, other long"


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows; those of a pair are the same bits whatever else is in the blocks."""
    out = np.empty((len(x), len(y)))
    step = max(1, CELLS // max(1, y.size))
    for lo in range(0, len(x), step):
        out[lo : lo + step] = np.sqrt(((x[lo : lo + step, None] - y[None]) ** 2).sum(-1))
    return out


def squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by a matrix product, and what they are off at most."""
    a, b = (x**2).sum(1), (y**2).sum(1)
    q = x @ y.T
    q *= -2
    q += a[:, None]
    q += b[None]
    return q, 1e-15 * (x.shape[1] + 1000) * float(a.max(initial=0) + b.max(initial=0))


def measured(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``distances`` of the rows ``i`` of ``x`` to the rows ``j`` of ``y``, the same bits."""
    out = np.empty(len(i))
    step = max(1, CELLS // max(1, x.shape[1]))
    for lo in range(0, len(i), step):
        at = slice(lo, lo + step)
        out[at] = np.sqrt(((x[i[at]] - y[j[at]]) ** 2).sum(-1))
    return out


def _stretches(x: np.ndarray, y: np.ndarray) -> Iterator[slice]:
    step = max(1, CELLS // max(1, len(y)))
    return (slice(lo, lo + step) for lo in range(0, len(x), step))


class Nearest:
    """The ``n`` nearest of what a block's vectors have met, by distance and key; ``far``: beyond it nothing counts."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, n: int, known: np.ndarray | None = None):
        self.ids, self.x, self.n = ids, x, n
        self.known = np.full((len(ids), n), np.inf) if known is None else known
        self.d, self.m = np.full((len(ids), n), np.inf), np.full((len(ids), n), np.iinfo(np.int64).max)
        self.far = self.known.max(1)

    def add(self, i: np.ndarray, d: np.ndarray, m: np.ndarray) -> None:
        near = d <= self.far[i]
        if not near.any():
            return
        i, d, m = i[near], d[near], m[near]
        order = np.lexsort((m, d, i))
        i, d, m = i[order], d[order], m[order]
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        place = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
        rows, kept = i[first], place < self.n
        at = np.searchsorted(rows, i[kept])
        new_d, new_m = np.full((len(rows), self.n), np.inf), np.full((len(rows), self.n), np.iinfo(np.int64).max)
        new_d[at, place[kept]], new_m[at, place[kept]] = d[kept], m[kept]
        both_d, both_m = np.concatenate([self.d[rows], new_d], axis=1), np.concatenate([self.m[rows], new_m], axis=1)
        best = np.lexsort((both_m, both_d), axis=1)[:, : self.n]
        self.d[rows], self.m[rows] = np.take_along_axis(both_d, best, axis=1), np.take_along_axis(both_m, best, axis=1)
        self.far[rows] = np.partition(np.concatenate([self.known[rows], self.d[rows]], axis=1), self.n - 1, axis=1)[:, self.n - 1]

    def meet(self, other: Nearest) -> None:
        """Both sides' candidates of all pairs; those of a block and itself, once."""
        for at in _stretches(self.x, other.x):
            q, slack = squares(self.x[at], other.x)
            if other is self:
                q[np.arange(len(q)), np.arange(len(self.x))[at]] = np.inf
            for mine, theirs, table, offset in ((self, other, q, at.start), (other, self, q.T, None)):
                if offset is None and other is self:
                    continue
                far = mine.far[at] if offset is not None else mine.far
                if table.shape[1] > mine.n:  # no row needs more than its own n nearest and their ties
                    wide = np.flatnonzero(~np.isfinite(far))
                    if len(wide):
                        far = far.copy()
                        far[wide] = np.sqrt(np.maximum(0, np.partition(table[wide], mine.n - 1, axis=1)[:, mine.n - 1] + 2 * slack))
                i, j = np.nonzero((table <= (far**2 * (1 + 1e-12) + 2 * slack)[:, None]) & np.isfinite(table))
                i, j = (i + offset, j) if offset is not None else (i, j + at.start)
                mine.add(i, measured(mine.x, theirs.x, i, j), theirs.ids[j])

    def rows(self) -> pa.RecordBatch:
        some = np.isfinite(self.d[:, 0])
        d, m = self.d[some], self.m[some]
        held = np.isfinite(d)
        entries = pa.StructArray.from_arrays([pa.array(d[held]), pa.array(m[held])], names=["d", "m"])
        return pa.RecordBatch.from_arrays([pa.array(self.ids[some]), pa.ListArray.from_arrays(pa.array(np.r_[0, held.sum(1).cumsum()].astype(np.int32)), entries)], names=["id", "found"])


class LeastEdges:
    """Each component's least edge of what blocks have met, in the order (length, smaller key, larger key)."""

    def __init__(self, comps: np.ndarray, bound: np.ndarray):
        self.comps, self.bound = comps, bound  # sorted; no edge that is longer counts
        self.best = tuple(np.zeros(0, k) for k in (np.int64, np.float64, np.int64, np.int64, np.int64))

    def meet(self, one: tuple, two: tuple) -> None:
        """Blocks as (ids, vectors, cores, numbers of components)."""
        (ids, x, core, c), (their_ids, y, their_core, their_c) = one, two
        if (c == c[0]).all() and (their_c == c[0]).all():
            return
        for at in _stretches(x, y):
            q, slack = squares(x[at], y)
            np.maximum(q, (core[at] ** 2)[:, None], out=q)
            np.maximum(q, (their_core**2)[None], out=q)
            q[c[at][:, None] == their_c[None]] = np.inf
            for table, own, other, turned in ((q, c[at], their_c, False), (q.T, their_c, c[at], True)):
                low = table.min(1)
                near = self.bound**2
                np.minimum.at(near, own, low)
                limit = near[own] * (1 + 1e-12) + 2 * slack
                some = np.flatnonzero(np.isfinite(low) & (low <= limit))
                i, j = np.nonzero(table[some] <= limit[some, None])
                i = some[i]
                if not len(i):
                    continue
                of, to = own[i], other[j]
                i, j = (j, i) if turned else (i, j)
                i = i + at.start
                w = np.maximum(measured(x, y, i, j), np.maximum(core[i], their_core[j]))
                self._add(of, w, np.minimum(ids[i], their_ids[j]), np.maximum(ids[i], their_ids[j]), self.comps[to])

    def _add(self, *edges: np.ndarray) -> None:
        of, w, a, b, other = (np.concatenate(p) for p in zip(self.best, edges, strict=True))
        order = np.lexsort((b, a, w, of))
        order = order[np.r_[True, of[order][1:] != of[order][:-1]]]
        self.best = tuple(v[order] for v in (of, w, a, b, other))
        self.bound[self.best[0]] = np.minimum(self.bound[self.best[0]], self.best[1])

    def rows(self) -> pa.RecordBatch:
        of, w, a, b, other = self.best
        return _rows({"comp": self.comps[of], "w": w, "a": a, "b": b, "other": other}, EDGE)


def tree_labels(a: np.ndarray, b: np.ndarray, w: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys, sorted, and their clusters, from a spanning tree's edges in ascending order. Clusters are numbered by their
    smallest key; -1 is noise."""
    keys = np.unique(np.concatenate([a, b]))
    n = len(keys)
    size = np.ones(2 * n - 1, np.int64)
    children = np.zeros((n - 1, 2), np.int64)
    top = np.arange(2 * n - 1)

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for k, (i, j) in enumerate(zip(np.searchsorted(keys, a).tolist(), np.searchsorted(keys, b).tolist(), strict=True)):
        i, j = root(i), root(j)
        top[i] = top[j] = n + k
        children[k], size[n + k] = (i, j), size[i] + size[j]
    # from the root down: a cluster lives on while only few keys fall off it
    of = np.zeros(2 * n - 1, np.int64)  # each node's cluster
    above, born, worth = [-1], [0.0], [0.0]
    for k in range(n - 2, -1, -1):
        c, (i, j) = of[n + k], children[k]
        density = 1 / w[k] if w[k] > 0 else 1e300
        split = min(size[i], size[j]) >= least
        for child in (i, j):
            if split:
                of[child] = len(above)
                above.append(int(c))
                born.append(density)
                worth.append(0.0)
            else:
                of[child] = c
            if split or size[child] < least:
                worth[c] += size[child] * (density - born[c])
    # the most stable clusters that don't hold one another; the whole is none
    below, parts, chosen = [0.0] * len(above), [0] * len(above), [False] * len(above)
    for c in range(len(above) - 1, 0, -1):
        chosen[c] = parts[c] == 0 or worth[c] >= below[c]
        below[above[c]] += worth[c] if chosen[c] else below[c]
        parts[above[c]] += 1
    named = [-1] * len(above)
    for c in range(1, len(above)):
        named[c] = named[above[c]] if named[above[c]] >= 0 else c if chosen[c] else -1
    found = np.array(named)[of[:n]]
    kinds, first = np.unique(found[found >= 0], return_index=True)
    number = dict(zip(kinds[np.argsort(np.flatnonzero(found >= 0)[first])].tolist(), range(len(kinds)), strict=True))
    return keys, np.array([number.get(int(c), -1) for c in found])


class Cells:
    """Pivots, and for each the least and largest distance of its vectors; a row a pivot, held by driver and tasks."""

    def __init__(self, pivots: np.ndarray, near: np.ndarray, far: np.ndarray, rows: int = 0):
        self.pivots, self.near, self.far, self.rows = pivots, near, far, rows

    def bound(self, x: np.ndarray) -> np.ndarray:
        """What each row is at least away from every vector of each cell (a little less, for rounding)."""
        d = distances(x, self.pivots)
        return np.maximum(0, np.maximum(d - self.far, self.near - d) * (1 - 1e-9) - 1e-12)


def _rows(table: dict, schema: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(table[n], types[k]) for n, k in zip(names, kinds, strict=True)], names=list(names))


def _blocks(df: DataFrame, key: str, vector: str, pivots: int, block: int) -> tuple[DataFrame, Cells]:
    """Written blocks ``block, cell, ids, vectors`` (ids ascending, as binary), and their cells."""
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda v: v.cast("double")).alias("v"))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()  # a bounded sample
    heads = np.array([r["v"] for r in sample], np.float64).reshape(len(sample), -1)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, -1)
            d = distances(x, heads)
            cell = d.argmin(1)
            yield _rows({"id": b.column(0), "v": [v.tobytes() for v in x], "cell": cell, "d": d[np.arange(len(x)), cell]}, "id long, v binary, cell long, d double")

    placed, placed_path = materialize(rows.mapInArrow(nearest, "id long, v binary, cell long, d double"), "density-rows")
    stats = {r["cell"]: r for r in placed.groupBy("cell").agg(F.min("d").alias("near"), F.max("d").alias("far"), F.count("*").alias("n")).collect()}  # a row a pivot
    near, far = (np.array([stats[c][name] if c in stats else fill for c in range(len(heads))]) for name, fill in (("near", np.inf), ("far", -np.inf)))
    parts = F.create_map(*(F.lit(x).cast("long") for c, r in stats.items() for x in (c, -(-r["n"] // block))))
    numbered = placed.withColumn("block", F.pmod(F.xxhash64("id"), parts[F.col("cell")]) * len(heads) + F.col("cell"))
    held = numbered.groupBy("block", "cell").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("r"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, cell, r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield _rows({"block": [number], "cell": [cell], "ids": [np.array([x["id"] for x in r], np.int64).tobytes()], "vectors": [b"".join(x["v"] for x in r)]}, "block long, cell long, ids binary, vectors binary")

    blocks, _ = materialize(held.mapInArrow(packed, "block long, cell long, ids binary, vectors binary"), "density-blocks")
    remove(df.sparkSession, placed_path)
    return blocks, Cells(heads, near, far, sum(r["n"] for r in stats.values()))


def _opened(ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(ids, np.int64)
    return found, np.frombuffer(vectors).reshape(len(found), -1)


def _met(rows: DataFrame, wanted: DataFrame, cells: Cells, work: Callable[[dict[int, dict], list[tuple[int, int]]], list[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` on the blocks of ``rows`` (a dictionary of their columns each) and the pairs of them that are to meet; ``wanted`` has blocks
    and the ``cells`` these visit. A task has the pairs between two groups of blocks."""
    groups = F.lit(max(LEAST_GROUPS, -(-cells.rows // GROUP_ROWS)))
    theirs = rows.select(F.col("block").alias("other"), F.col("cell").alias("to"))
    met = wanted.select("block", F.explode("cells").alias("to")).join(theirs, "to").where("block <> other")
    pairs = met.select(F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b")).distinct()
    one, two = (F.pmod(F.xxhash64(c), groups) for c in ("a", "b"))
    pairs = pairs.select("a", "b", F.least(one, two).alias("g"), F.greatest(one, two).alias("h"))
    nobody = F.lit(None).cast("long")
    sides = pairs.select("g", "h", F.explode(F.array(F.struct(F.col("a").alias("block"), F.col("b").alias("other")), F.struct(F.col("b").alias("block"), nobody.alias("other")))).alias("s"))
    sides = sides.groupBy("g", "h", "s.block").agg(F.collect_list("s.other").alias("others"))

    def run(part: pa.Table) -> pa.Table:
        held = {r["block"]: r for r in part.to_pylist()}
        return pa.Table.from_batches(work(held, [(r["block"], b) for r in held.values() for b in r["others"]]))

    # numbers of blocks are joined first, and vectors are never the broadcast side: a block's row is repeated by this join
    return rows.join(sides.hint("merge"), "block").groupBy("g", "h").applyInArrow(run, schema)


def _nearest(blocks: DataFrame, cells: Cells, n: int, probes: int | None = None) -> DataFrame:
    """``id, found``: every vector's ``n`` nearest others (``d``, ``m``), in order."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, cell, packed, vectors in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, x = _opened(packed, vectors)
                near = Nearest(ids, x, n)
                near.meet(near)
                can = cells.bound(x) <= near.far[:, None]
                if probes is not None:
                    can &= np.argsort(np.argsort(distances(x, cells.pivots), axis=1, kind="stable"), axis=1) < probes
                lists = (near.d.tobytes(), near.m.tobytes())
                yield pa.RecordBatch.from_arrays([*(pa.array([v]) for v in (number, cell, packed, vectors, *lists)), pa.array([np.flatnonzero(can.any(0)).tolist()], pa.list_(pa.int64()))], names=["block", "cell", "ids", "vectors", "d", "m", "cells"])

    def others(held: dict[int, dict], pairs: list[tuple[int, int]]) -> list[pa.RecordBatch]:
        near = {k: Nearest(*_opened(r["ids"], r["vectors"]), n, np.frombuffer(r["d"]).reshape(-1, n)) for k, r in held.items()}
        for a, b in pairs:
            near[a].meet(near[b])
        return [x.rows() for x in near.values()]

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for packed, d, m in zip(*(c.to_pylist() for c in b.columns), strict=True):
                near = Nearest(np.frombuffer(packed, np.int64), np.empty((0, 0)), n)
                near.d, near.m = np.frombuffer(d).reshape(-1, n), np.frombuffer(m, np.int64).reshape(-1, n)
                yield near.rows()

    routed, _ = materialize(blocks.select("block", "cell", "ids", "vectors").mapInArrow(own, "block long, cell long, ids binary, vectors binary, d binary, m binary, cells array<long>"), "density-neighbours")
    found = _met(routed.drop("m", "cells"), routed.select("block", "cells"), cells, others, NEAREST).unionByName(routed.select("ids", "d", "m").mapInArrow(alone, NEAREST))
    return found.groupBy("id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, n).alias("found"))


def _place(found: str, place: int) -> Column:
    """The distance at a place of a list; what has no such place lists all others."""
    return F.coalesce(F.get(found, F.lit(place - 1))["d"], F.lit(float("inf")))


def core_distances(blocks: DataFrame, cells: Cells, least: int) -> DataFrame:
    """``id, core``: the distance to the ``least``-th nearest other vector."""
    return _nearest(blocks, cells, least).select("id", _place("found", least).alias("core"))


def needed(one: tuple, two: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of two blocks can have an unlisted edge that is no longer than the best known of a component. Blocks as (distances at
    which lists end, best known edges of the rows' components)."""
    top = [w[reach <= w].max(initial=-np.inf) for reach, w in (one, two)]
    return tuple((reach <= w) | (reach <= other) for (reach, w), other in ((one, top[1]), (two, top[0])))


def spanning_tree(blocks: DataFrame, cells: Cells, cores: DataFrame, lists: DataFrame | None = None, rounds: int = 64) -> DataFrame:
    """``a, b, w``: the edges (a < b) of the minimum spanning tree of mutual reachability. ``cores``: ``id, block, core``, and with
    ``lists`` (``id, m, d``: the nearest of every vector) ``reach``, the distance of the last listed."""
    spark = blocks.sparkSession
    if lists is None:
        cores = cores.withColumn("reach", F.lit(0.0))
    else:
        ends = [cores.select(F.col("id").alias(key), F.col("core").alias(f"core_{key}")) for key in ("id", "m")]
        listed = lists.join(ends[0], "id").join(ends[1], "m").select("id", "m", F.greatest("d", "core_id", "core_m").alias("w"))
        lists, lists_path = materialize(listed, "density-listed")

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for packed, vectors, core, comp in zip(*(c.to_pylist() for c in b.columns), strict=True):
                comps, numbers = np.unique(np.array(comp, np.int64), return_inverse=True)
                mine = (*_opened(packed, vectors), np.array(core), numbers)
                edges = LeastEdges(comps, np.full(len(comps), np.inf))
                edges.meet(mine, mine)
                yield edges.rows()

    def routing(whole: dict[int, int]) -> Callable:
        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                columns = {n: b.column(k) for k, n in enumerate(b.schema.names)}
                to: list[list[int]] = []
                for packed, vectors, core, comp, w, reach in zip(*(columns[n].to_pylist() for n in ("ids", "vectors", "core", "comp", "w", "reach")), strict=True):
                    _, x = _opened(packed, vectors)
                    w = np.array([np.inf if v is None else v for v in w])
                    can = np.maximum(cells.bound(x), np.array(core)[:, None]) <= w[:, None]
                    inner = np.array([whole.get(c, -1) for c in range(can.shape[1])])
                    can &= (np.array(comp)[:, None] != inner) & (np.array(reach) <= w)[:, None]
                    to.append(np.flatnonzero(can.any(0)).tolist())
                yield pa.RecordBatch.from_arrays([columns["block"], pa.array(to, pa.list_(pa.int64()))], names=["block", "cells"])

        return route

    def across(held: dict[int, dict], pairs: list[tuple[int, int]]) -> list[pa.RecordBatch]:
        comps, numbers = np.unique(np.concatenate([np.array(r["comp"], np.int64) for r in held.values()]), return_inverse=True)
        bound = np.full(len(comps), np.inf)
        reached = {}
        numbers = np.split(numbers, np.cumsum([len(r["comp"]) for r in held.values()])[:-1])
        for (k, r), c in zip(held.items(), numbers, strict=True):
            w = np.array([np.inf if v is None else v for v in r["w"]])
            np.minimum.at(bound, c, w)
            reached[k] = np.array(r["reach"]), w
        blocks = {k: (*_opened(r["ids"], r["vectors"]), np.array(r["core"]), c) for (k, r), c in zip(held.items(), numbers, strict=True)}
        edges = LeastEdges(comps, bound)
        for a, b in pairs:
            keep = needed(reached[a], reached[b])
            if keep[0].any() and keep[1].any():
                edges.meet(*(blocks[k] if some.all() else tuple(c[some] for c in blocks[k]) for k, some in zip((a, b), keep, strict=True)))
        return [edges.rows()]

    def nearest_listed(comps: DataFrame) -> DataFrame:
        ends = [comps.select(F.col("id").alias(key), F.col("comp").alias(comp)) for key, comp in (("id", "comp"), ("m", "other"))]
        met = lists.join(ends[0], "id").join(ends[1], "m").where("comp <> other")
        sides = F.array(*(F.struct(F.col(x).alias("comp"), F.col(y).alias("other")) for x, y in (("comp", "other"), ("other", "comp"))))
        return met.select(F.explode(sides).alias("s"), "w", F.least("id", "m").alias("a"), F.greatest("id", "m").alias("b")).select("s.comp", "w", "a", "b", "s.other")

    comps, comps_path = materialize(cores.select("id", "block", "core", "reach", F.col("id").alias("comp")), "density-components")
    tree = None
    for _ in range(rounds):
        if comps.select("comp").distinct().limit(2).count() < 2:
            break

        def with_state(best: DataFrame | None, comps: DataFrame = comps) -> DataFrame:
            rows = comps.withColumn("w", F.lit(None).cast("double")) if best is None else comps.join(best.select("comp", "e.w"), "comp", "left")
            lists = rows.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("id", "core", "comp", "w", "reach"))).alias("r"))
            return blocks.join(lists, "block").select("block", "cell", "ids", "vectors", F.col("r.core").alias("core"), F.col("r.comp").alias("comp"), F.col("r.w").alias("w"), F.col("r.reach").alias("reach"))

        edge = F.min(F.struct("w", "a", "b", "other")).alias("e")
        within = with_state(None).select("ids", "vectors", "core", "comp").mapInArrow(inside, EDGE)
        first, first_path = materialize((within if lists is None else within.unionByName(nearest_listed(comps))).groupBy("comp").agg(edge), "density-edges")
        state, state_path = materialize(with_state(first), "density-state")
        of_cell = comps.withColumn("cell", F.pmod("block", F.lit(len(cells.pivots)))).groupBy("cell").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        whole = {r["cell"]: r["lo"] for r in of_cell.where("lo = hi").collect()}  # a row a pivot
        wanted = state.mapInArrow(routing(whole), "block long, cells array<long>")
        found = _met(state, wanted, cells, across, EDGE).unionByName(first.select("comp", "e.*"))
        best, best_path = materialize(found.groupBy("comp").agg(edge), "density-edges")
        new, _ = materialize(best.select("e.a", "e.b", "e.w").distinct(), "density-tree")
        tree = new if tree is None else tree.unionByName(new)
        roots, roots_path = _roots(best.select("comp", F.col("e.other").alias("to")))
        after, after_path = materialize(comps.join(roots, "comp").select("id", "block", "core", "reach", F.col("root").alias("comp")), "density-components")
        for path in (comps_path, first_path, state_path, best_path, roots_path):
            remove(spark, path)
        comps, comps_path = after, after_path
    else:
        raise RuntimeError(f"no single tree after {rounds} rounds")
    remove(spark, comps_path)
    if lists is not None:
        remove(spark, lists_path)
    return tree


def _roots(pointers: DataFrame) -> tuple[DataFrame, str]:
    """``comp, root``, written: where ``to`` of every component leads. The least edges of a total order close no circle but
    between two components, whose smaller one is the root."""
    spark = pointers.sparkSession
    back = pointers.select(F.col("comp").alias("to"), F.col("to").alias("back"))
    start = pointers.join(back, "to").select("comp", F.when((F.col("back") == F.col("comp")) & (F.col("comp") < F.col("to")), F.col("comp")).otherwise(F.col("to")).alias("root"))
    held, path = materialize(start, "density-roots")
    while True:
        further = held.select(F.col("comp").alias("root"), F.col("root").alias("next"))
        after, after_path = materialize(held.join(further, "root").select("comp", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "density-roots")
        moved = after.where("moved").limit(1).count()
        remove(spark, path)
        held, path = after.select("comp", "root"), after_path
        if not moved:
            return held, path


def neighbours(df: DataFrame, key: str, vector: str, n: int, probes: int | None = None, pivots: int = 64, block: int = 1024) -> DataFrame:
    """``key, match, distance, place``: every vector's ``n`` nearest others, ties by key; an inverted index over coarse centroids.

    All vectors are queries and all are indexed: each lies in the block of its nearest pivot. Blocks meet the cells that the triangle
    inequality can't rule out (exact), or with ``probes`` those among each of its vectors' so many nearest pivots; what they meet is compared exactly.
    A block gives back ``n`` rows a vector, never pairs.
    """
    kind = dict(df.dtypes)[key]
    if df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).limit(2).count() < 2:
        return df.sparkSession.createDataFrame([], f"`{key}` {kind}, match {kind}, distance double, place int")
    blocks, cells = _blocks(df, key, vector, pivots, block)
    best = _nearest(blocks, cells, n, probes)
    rows = best.select(F.col("id").cast(kind).alias(key), F.posexplode("found").alias("at", "f"))
    return rows.select(key, F.col("f.m").cast(kind).alias("match"), F.col("f.d").alias("distance"), (F.col("at") + 1).alias("place"))


def density_clusters(df: DataFrame, key: str, vector: str, least: int = 3, pivots: int = 64, block: int = 1024) -> DataFrame:
    """``key, cluster`` of every row: clusters of all vectors, numbered by their smallest key; -1 is noise. ``least``: rows of a
    cluster, and neighbours of a core."""
    spark = df.sparkSession
    noise = df.select(F.col(key), F.lit(-1).cast("long").alias("cluster"))
    if df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).limit(least + 1).count() <= least:
        return noise
    blocks, cells = _blocks(df, key, vector, pivots, block)
    of_block = _members(blocks)
    most = max(least, LISTED)
    near, near_path = materialize(_nearest(blocks, cells, most), "density-lists")
    cores, cores_path = materialize(near.select("id", _place("found", least).alias("core"), _place("found", most).alias("reach")).join(of_block, "id"), "density-cores")
    tree = spanning_tree(blocks, cells, cores, near.select("id", F.explode("found").alias("f")).select("id", "f.m", "f.d"))
    for path in (cores_path, near_path):
        remove(spark, path)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches]
        if parts:
            keys, found = tree_labels(*(np.concatenate(c) for c in zip(*parts, strict=True)), least)
            for lo in range(0, len(keys), 1 << 16):
                yield _rows({"id": keys[lo : lo + (1 << 16)], "cluster": found[lo : lo + (1 << 16)]}, "id long, cluster long")

    labels = tree.coalesce(1).sortWithinPartitions("w", "a", "b").select("a", "b", "w").mapInArrow(label, "id long, cluster long")
    labels = labels.select(F.col("id").alias("__id"), F.col("cluster").alias("__cluster"))
    met = df.select(key).join(labels, F.col(key).cast("long") == F.col("__id"), "left")
    return met.select(key, F.coalesce("__cluster", F.lit(-1).cast("long")).alias("cluster"))


def _members(blocks: DataFrame) -> DataFrame:
    """``id, block`` of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = np.frombuffer(packed, np.int64)
                yield _rows({"id": ids, "block": np.full(len(ids), number)}, "id long, block long")

    return blocks.select("block", "ids").mapInArrow(run, "id long, block long")
