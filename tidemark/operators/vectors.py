"""Operators on feature vectors (arrays of equal length)."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import dot, euclidean

#: Pairs of a query and a row that are compared at a time.
PAIRS = 1 << 21
#: Where all rows are queries: groups of a large table at least, and what a group holds at most (a task holds two).
LEAST_GROUPS, GROUP_BYTES = 12, 64 << 20
#: Rows and columns of a tile of two groups; the first columns are few, so that most of the others can be ruled out by what they give.
TILE, FIRST_TILE = (256, 4096), 256
#: The rank of a pair without similarity: it comes after any other.
NONE = 1e6
FOUND = "query long, found array<struct<rank:double,match:long>>"


def medians(df: DataFrame, group: str, vector: str) -> DataFrame:
    """``group, pos, x``: the exact median of every place, read off cumulated counts. Values are counted where they are and the
    counts summed, so a place takes as many rows as it has distinct values (256 for pixels), however many vectors there are. Null
    values don't count."""
    places = df.select(group, F.posexplode(vector).alias("pos", "x")).where("x IS NOT NULL")
    counts = places.groupBy(group, "pos", "x").agg(F.count("*").alias("n"))
    place = Window.partitionBy(group, "pos")
    counts = counts.withColumns({"until": F.sum("n").over(place.orderBy("x")), "all": F.sum("n").over(place)})
    at = lambda k: F.min(F.when(F.col("until") > F.floor(k / 2), F.col("x").cast("double")))
    return counts.groupBy(group, "pos").agg(((at(F.col("all") - 1) + at(F.col("all"))) / 2).alias("x"))


def pooled(df: DataFrame, group: str, vector: str, how: str = "avg", to: str = "pooled") -> DataFrame:
    """``group, to``: the vectors' mean (or ``median``) place by place. Places are partial sums (or counts), not lists of vectors."""
    mean = lambda: df.select(group, F.posexplode(vector).alias("pos", "x")).groupBy(group, "pos").agg(F.avg("x").alias("x"))
    per = medians(df, group, vector) if how == "median" else mean()
    return per.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias(to))


def representatives(df: DataFrame, n: int, cluster: str, vector: str, key: str) -> DataFrame:
    """``cluster, key, distance, place``: the ``n`` rows nearest to each cluster's centroid; noise (-1) has none."""
    kept = df.where(F.col(cluster) != -1)
    far = kept.join(pooled(kept, cluster, vector, to="__c"), cluster).select(cluster, key, F.round(euclidean(F.col(vector), F.col("__c")), 6).alias("distance"))
    return far.withColumn("place", F.row_number().over(Window.partitionBy(cluster).orderBy("distance", key))).where(F.col("place") <= n)


def total(v: np.ndarray) -> np.ndarray:
    """Sums of rows, place by place as Spark's ``aggregate`` takes them."""
    return np.add.accumulate(v, axis=1)[:, -1]


def exact_cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``scalars.cosine`` of the rows of both with no guard, summed in the same order; not a number where a length is 0."""
    lengths = np.sqrt(total(x * x)) * np.sqrt(total(y * y))
    return np.divide(total(x * y), lengths, out=np.full(len(x), np.nan), where=lengths != 0)


def in_units(s: np.ndarray) -> np.ndarray:
    """Likenesses rounded to whole ten-thousandths as ``round`` does: by their decimals, halves away from 0."""
    t = s * 1e4
    out = np.rint(t)
    for k in np.flatnonzero(np.abs(np.abs(t - np.trunc(t)) - 0.5) < 1e-6).tolist():
        out[k] = float(Decimal(repr(float(s[k]))).scaleb(4).quantize(Decimal(1), ROUND_HALF_UP))
    return out


def keep(rank: np.ndarray, match: np.ndarray, i: np.ndarray, r: np.ndarray, m: np.ndarray) -> None:
    """Put the ranks ``r`` and matches ``m`` of the rows ``i`` among these rows' best, by rank and match."""
    if not len(i):
        return
    n = rank.shape[1]
    order = np.lexsort((m, r, i))
    i, r, m = i[order], r[order], m[order]
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    place = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
    at, some = i[first], place < n
    to = np.searchsorted(at, i[some])
    more, theirs = np.full((len(at), n), np.inf), np.full((len(at), n), np.iinfo(np.int64).max)
    more[to, place[some]], theirs[to, place[some]] = r[some], m[some]
    both, ids = np.concatenate([rank[at], more], axis=1), np.concatenate([match[at], theirs], axis=1)
    best = np.lexsort((ids, both), axis=1)[:, :n]
    rank[at], match[at] = np.take_along_axis(both, best, axis=1), np.take_along_axis(ids, best, axis=1)


def most_similar(queries: DataFrame, rows: DataFrame, n: int, key: str, vector: str, largest: bool = True, query_bytes: int = 64 << 20) -> DataFrame:
    """``query, match, similarity, place``: the ``n`` rows most (or least) similar to every query, itself
    excluded. The queries are a stated set, checked to fit ``query_bytes``, and meet the rows in blocks.

    A block is compared with all queries by one matrix product, which only rules pairs out; similarities of those that may be
    among the ``n`` are ``scalars.cosine``'s, rounded to four places. A task keeps ``n`` rows a query. Vectors of other lengths than the
    first query's, with null places or of length 0 have no similarity and come last.
    """
    q = queries.where(F.col(key).isNotNull()).select(F.col(key).alias("query"), F.transform(vector, lambda v: v.cast("double")).alias("v"))
    size = q.agg(F.sum(F.coalesce(F.size("v"), F.lit(0)) * 8 + 16)).first()[0] or 0
    if size > query_bytes:
        raise ValueError(f"the queries take {size} bytes; pass them in sets of {query_bytes} at most")
    kind = dict(rows.dtypes)[key]
    held = q.orderBy("query").collect()  # the stated set
    d = next((len(r["v"]) for r in held if r["v"]), 1)
    sound = lambda v: v is not None and len(v) == d and None not in v
    names = np.array([r["query"] for r in held], np.int64)
    asked = np.array([r["v"] if sound(r["v"]) else [np.nan] * d for r in held], np.float64).reshape(-1, d)
    sign = -1.0 if largest else 1.0

    def unit(x: np.ndarray) -> np.ndarray:
        length = np.sqrt((x * x).sum(1, keepdims=True))
        return np.divide(x, length, out=np.full(x.shape, np.nan), where=length != 0)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, match = np.full((len(names), n), np.inf), np.full((len(names), n), np.iinfo(np.int64).max)
        scaled = unit(asked) * (1e4 * sign)

        for b in batches:
            for lo in range(0, b.num_rows, step := max(64, PAIRS // max(1, len(names)))):
                part = b.slice(lo, step)
                ids = part.column(0).to_numpy()
                column = part.column(1)
                if column.null_count or column.flatten().null_count or len(column.flatten()) != d * len(ids) or not (np.diff(column.offsets.to_numpy()) == d).all():
                    x = np.array([v if sound(v) else [np.nan] * d for v in column.to_pylist()], np.float64).reshape(-1, d)
                else:
                    x = column.flatten().to_numpy().reshape(-1, d)
                t = scaled @ unit(x).T
                t[np.isnan(t)] = NONE
                t[names[:, None] == ids[None]] = np.inf
                limit = rank[:, -1]
                if t.shape[1] > n:
                    wide = np.flatnonzero(~np.isfinite(limit))
                    if len(wide):
                        limit = limit.copy()
                        limit[wide] = np.partition(t[wide], n - 1, axis=1)[:, n - 1] + 1
                i, j = np.nonzero((t <= (limit + 1)[:, None]) & np.isfinite(t))
                for at in range(0, len(i), PAIRS // d + 1):
                    one, two = i[at : at + PAIRS // d + 1], j[at : at + PAIRS // d + 1]
                    s = in_units(exact_cosine(asked[one], x[two]))
                    keep(rank, match, one, np.where(np.isnan(s), NONE, sign * s), ids[two])
        some = np.isfinite(rank)
        i, _ = np.nonzero(some)
        yield pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(match[some]), pa.array(rank[some])], names=["query", "match", "rank"])

    vectors = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("m"), F.transform(vector, lambda v: v.cast("double")).alias("v"))
    found = vectors.mapInArrow(nearest, "query long, match long, rank double") if len(names) else vectors.selectExpr("m AS query", "m AS match", "0D AS rank").where("false")
    return placed(found.groupBy("query").agg(F.slice(F.sort_array(F.collect_list(F.struct("rank", "match"))), 1, n).alias("r")), kind, sign)


def placed(best: DataFrame, kind: str, sign: float) -> DataFrame:
    """``query, match, similarity, place`` of the queries' lists ``r``."""
    best = best.select(F.col("query").cast(kind).alias("query"), F.posexplode("r").alias("at", "r"))
    similarity = F.when(F.col("r.rank") < NONE, F.round(F.col("r.rank") * sign) / 10_000 + F.lit(0.0))
    return best.select("query", F.col("r.match").cast(kind).alias("match"), similarity.alias("similarity"), (F.col("at") + 1).alias("place"))


class Likest:
    """A group's vectors, by key, and the ``n`` best of what each has met, by rank and key."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, n: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.n = ids[order], x[order].astype(np.float64), n
        self.length, self.unit = np.empty(len(ids)), np.empty(x.shape, np.float32)
        for lo in range(0, len(ids), 1 << 13):
            at = slice(lo, lo + (1 << 13))
            self.length[at] = np.sqrt(total(self.x[at] ** 2))
            self.unit[at] = self.x[at] / self.length[at, None]
        self.rank, self.match = np.full((len(ids), n), np.inf), np.full((len(ids), n), np.iinfo(np.int64).max)

    def fill(self, ids: np.ndarray) -> None:
        """Begin with rows that have no similarity, ascending by key."""
        for k in range(len(self.ids) if len(ids) else 0):
            mine = ids[ids != self.ids[k]][: self.n]
            self.rank[k, : len(mine)], self.match[k, : len(mine)] = NONE, mine

    def offer(self, other: Likest, t: np.ndarray, lo: int, their_lo: int, slack: float, sign: float) -> None:
        """Take what may be among the best of the rows from ``lo`` on; ``t``: their signed likenesses to the other's rows from
        ``their_lo`` on, off by ``slack`` at most. Every ``k``-th column is a chunk, and only chunks whose best may count are looked through."""
        columns = t.shape[1]
        k = min(columns, max(64, columns // 16))
        if rest := columns % k:
            self.offer(other, t[:, -rest:], lo, their_lo + columns - rest, slack, sign)
            t = t[:, :-rest]
        t = t.reshape(len(t), -1, k)
        best = t.min(1)
        last, worst = self.rank[lo : lo + len(t), -1], self.match[lo : lo + len(t), -1]
        high = np.where(last < NONE, (last + 0.5) * 1e-4 + slack, np.inf).astype(np.float32)
        some = np.flatnonzero(best.min(1) <= high)
        if not len(some):
            return
        best, high, worst = best[some], high[some], worst[some]
        better = ((last[some] - 0.5) * 1e-4 + slack).astype(np.float32)  # what is surely no better than a row's last must have a smaller key
        if k >= self.n:  # the n-th best of the chunks' best is no better than the n-th best
            high = np.minimum(high, np.partition(best, self.n - 1, axis=1)[:, self.n - 1] + np.float32(2 * slack + 1e-4))
        ids = other.ids[their_lo : their_lo + columns]
        hit, chunk = np.nonzero((best <= high[:, None]) & ((best < better[:, None]) | (ids[:k] < worst[:, None])))
        cells = t[some[hit], :, chunk]
        h, c = np.nonzero((cells <= high[hit, None]) & (cells < np.inf))
        row, j = hit[h], c * k + chunk[h]
        open_ = (cells[h, c] < better[row]) | (ids[j] < worst[row])
        i, j = lo + some[row[open_]], their_lo + j[open_]
        for at in range(0, len(i), step := PAIRS // self.x.shape[1] + 1):
            one, two = i[at : at + step], j[at : at + step]
            s = total(self.x[one] * other.x[two]) / (self.length[one] * other.length[two])
            keep(self.rank, self.match, one, sign * in_units(s), other.ids[two])

    def meet(self, other: Likest, sign: float) -> None:
        """Both sides' candidates of all pairs; a group's own once, without those of one key. Other groups have other keys."""
        size = lambda x: np.sqrt((x.astype(np.float64) ** 2).sum(1).max(initial=1.0))
        slack = (self.x.shape[1] + 8) * 2.0**-23 * size(self.unit) * size(other.unit)
        left, right = (np.searchsorted(other.ids, self.ids, side) for side in ("left", "right"))
        signed = other.unit.T * np.float32(sign)
        edges = [0, *range(FIRST_TILE, len(other.ids), TILE[1]), len(other.ids)]
        for lo in range(0, len(self.ids), TILE[0]):
            rows = self.unit[lo : lo + TILE[0]]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                t = rows @ signed[:, start:end]
                if other is self:
                    for k in range(len(rows)):
                        t[k, max(0, left[lo + k] - start) : max(0, right[lo + k] - start)] = np.inf
                self.offer(other, t, lo, start, slack, sign)
                if other is not self:
                    other.offer(self, t.T, start, lo, slack, sign)

    def rows(self) -> pa.RecordBatch:
        held = np.isfinite(self.rank)
        entries = pa.StructArray.from_arrays([pa.array(self.rank[held]), pa.array(self.match[held])], names=["rank", "match"])
        return pa.RecordBatch.from_arrays([pa.array(self.ids), pa.ListArray.from_arrays(pa.array(np.r_[0, held.sum(1).cumsum()].astype(np.int32)), entries)], names=["query", "found"])


def most_similar_of_all(df: DataFrame, n: int, key: str, vector: str, largest: bool = True, group_rows: int = 2048) -> DataFrame:
    """``query, match, similarity, place``: ``most_similar`` with all rows as queries.

    Rows are dealt into groups by their keys, small tables into groups of ``group_rows``, and a task compares two groups, each pair once for both sides: a row is sent
    as often as there are groups, and the comparisons grow with the square of the rows. Matrix products in single precision only rule pairs
    out; similarities of those that may be among the ``n`` are ``scalars.cosine``'s, rounded to four places. A task gives back ``n`` rows a
    query. Vectors of other lengths than the smallest key's, with null places or whose length is 0 or no finite number have no similarity and
    come last.
    """
    kind, source = dict(df.dtypes)[key], dict(df.dtypes)[vector]
    single = source == "array<float>"
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v"))
    d = rows.where(F.size("v") > 0).agg(F.min_by(F.size("v"), "id")).first()[0] or 1
    long = F.sqrt(dot(F.col("v"), F.col("v")))
    sound = F.coalesce((F.size("v") == d) & ~F.exists("v", lambda x: x.isNull()) & (long > 0) & (long < float("inf")), F.lit(False))
    rows = rows.withColumn("sound", sound)
    sizes = {r["sound"]: r["count"] for r in rows.groupBy("sound").count().collect()}
    count = sizes.get(True, 0)
    sign = -1.0 if largest else 1.0
    groups = max(1, min(LEAST_GROUPS, -(-count // group_rows)), -(-count * d * 8 // GROUP_BYTES))

    def smallest(rows: DataFrame) -> list[int]:
        """The keys that come first where no pair has a similarity: of ``n + 1`` distinct ones ``n`` rows at most."""
        return [r["id"] for r in rows.groupBy("id").count().orderBy("id").limit(n + 1).collect() for _ in range(min(n, r["count"]))]

    fill = np.array(smallest(rows.where("NOT sound")) if sizes.get(False) else [], np.int64)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            x = b.column(2).flatten().to_numpy().reshape(-1, d)
            own = [(int(k), g == k) for k in np.unique(g)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.int64()), pa.array([ids[at].tobytes() for _, at in own], pa.binary()), pa.array([x[at].tobytes() for _, at in own], pa.binary())], names=["own", "ids", "vectors"])

    def compared(part: pa.Table) -> pa.Table:
        g, h = part.column("g")[0].as_py(), part.column("h")[0].as_py()
        held: dict[int, list[tuple]] = {}
        for own, ids, vectors in zip(*(part.column(c) for c in ("own", "ids", "vectors")), strict=True):
            held.setdefault(own.as_py(), []).append((np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(vectors.as_buffer(), np.float32 if single else np.float64).reshape(-1, d)))
        sides = [Likest(*(np.concatenate(c) for c in zip(*parts, strict=True)), n) for parts in held.values()]
        if g == h:
            sides[0].fill(fill)
            sides[0].meet(sides[0], sign)
        elif len(sides) == 2:
            sides[0].meet(sides[1], sign)
        return pa.Table.from_batches([s.rows() for s in sides])

    blocks = rows.where("sound").select(F.pmod(F.xxhash64("id"), F.lit(groups)).alias("g"), "id", "v").mapInArrow(packed, "own long, ids binary, vectors binary")
    sides = blocks.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>"))).select(F.least("own", "to").alias("g"), F.greatest("own", "to").alias("h"), "own", "ids", "vectors")
    found = sides.repartition(groups * (groups + 1) // 2, "g", "h").groupBy("g", "h").applyInArrow(compared, FOUND)
    if sizes.get(False):
        first = F.array(*(F.struct(F.lit(NONE).alias("rank"), F.lit(m).cast("long").alias("match")) for m in smallest(rows)))
        found = found.unionByName(rows.where("NOT sound").select(F.col("id").alias("query"), F.filter(first, lambda r: r["match"] != F.col("id")).alias("found")))
    best = found.groupBy("query").agg(F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, n).alias("r"))
    return placed(best, kind, sign)
