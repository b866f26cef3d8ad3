"""SimHash near-duplicates by anchor points of a covering code.

Fingerprints. Every word shingle's XXH64 votes on 64 bits; a bit is set if over half of the shingles set it.

Anchors. The perfect binary Golay code covers 23 bits with radius 3; the product of two covers the
fingerprint's first 46 bits with radius 3 in each half. If two fingerprints differ in at most t bits, a
point between them differs from either in at most t/2 (rounded up), and that point has an anchor within the covering radius.
So both lie within the radius plus t/2 of one anchor: every fingerprint is sent to all anchors within
covering radius plus its half of the threshold, and fingerprints are compared per anchor. No link is lost;
for t = 4 that is about 61 of 16.8 million anchors.

Equal fingerprints are merged before. A task reads its anchors in order and holds ``block`` fingerprints of
one anchor at most; it returns, of each block, a spanning forest of the links. Anchors with more are rare
(large groups of near copies): their blocks are compared pairwise in tasks of their own. Forests become
components by alternating large-star and small-star rounds over salted joins.

Cases: null and empty texts have no words and fingerprint zero, linked like any other; fewer words than a
shingle give one shingle; repeated rows share a fingerprint; rows with a null id get their component's
smallest id, or null in a component without ids; other columns aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import dealt_join
from .common import materialize, remove, text_or_empty

SEED = 42
GOLAY = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def fingerprint(text: str, words: int = 4) -> int:
    """The unsigned SimHash of one text."""
    parts = text.encode().lower().split()  # bytes: A-Z and \x20 \x09-\x0D alone
    if not parts:
        return 0
    joined = b" ".join(parts)
    end = np.cumsum([len(p) + 1 for p in parts]) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    last = end[min(words, len(parts)) - 1 :]
    votes, hash_ = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for lo in range(0, n, 1 << 16):
        h = [hash_(joined[a:b], SEED) for a, b in zip(start[lo : min(n, lo + (1 << 16))].tolist(), last[lo : lo + (1 << 16)].tolist(), strict=False)]
        votes += np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fp long`` (the bits as a signed number) of every whole text. One narrow pass."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    return docs.select(id_col, text_or_empty(text_col)).mapInArrow(run, f"`{id_col}` {kind}, fp long")


class GolayAnchors:
    """Error patterns of the [23, 12] Golay code by syndrome, in order of what they exceed the radius by."""

    def __init__(self, slack: int):
        weight = 3 + slack
        words = [0]
        layer = [(0, -1)]
        for _ in range(weight):
            layer = [(w | 1 << k, k) for w, top in layer for k in range(top + 1, 23)]
            words += [w for w, _ in layer]
        errors = np.array(words, np.int64)
        s = self.syndrome(errors)
        excess = np.maximum(np.bitwise_count(errors).astype(np.int64) - 3, 0)
        order = np.lexsort((excess, s))
        self.errors, self.excess = errors[order], excess[order]
        self.start = np.searchsorted(s[order], np.arange(2049))
        self.slack = slack

    @staticmethod
    def syndrome(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for k in range(22, 10, -1):
            x ^= np.where(x >> k & 1, GOLAY << (k - 11), 0)
        return x

    def near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor's 12 information bits, excess) of all anchors within radius plus slack of 23-bit numbers."""
        s = self.syndrome(x)
        n = self.start[s + 1] - self.start[s]
        row = np.repeat(np.arange(len(x)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[s], n)
        return row, (x[row] ^ self.errors[at]) >> 11, self.excess[at]


def anchors(fps: np.ndarray, code: GolayAnchors) -> tuple[np.ndarray, np.ndarray]:
    """(row, 24-bit anchor) of all anchors that fingerprints are sent to."""
    u = fps.view(np.uint64)
    low, high = (u & np.uint64(0x7FFFFF)).astype(np.int64), (u >> np.uint64(23) & np.uint64(0x7FFFFF)).astype(np.int64)
    r1, a1, e1 = code.near(low)
    r2, a2, e2 = code.near(high)
    n1, n2 = np.bincount(r1, minlength=len(u)), np.bincount(r2, minlength=len(u))
    # every pair of a row's two lists whose excesses together stay within the slack
    per = n2[r1]
    left = np.repeat(np.arange(len(r1)), per)
    right = np.arange(len(left)) - np.repeat(np.cumsum(per) - per, per) + np.repeat((np.cumsum(n2) - n2)[r1], per)
    fits = e1[left] + e2[right] <= code.slack
    left, right = left[fits], right[fits]
    return r1[left], a1[left] << 12 | a2[right]


def forest(key: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of a spanning forest of the links (``most`` differing bits or fewer) within equal, sorted keys."""
    n = len(fp)
    root, edges_i, edges_j = np.arange(n), [], []
    at = np.arange(n)
    for lag in range(1, n):
        at = at[at + lag < n]
        at = at[key[at] == key[at + lag]]
        if not len(at):
            break
        linked = at[np.bitwise_count(fp[at] ^ fp[at + lag]) <= most]
        linked = linked[root[linked] != root[linked + lag]]
        for i, j in zip(linked.tolist(), (linked + lag).tolist(), strict=True):
            a, b = i, j
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
                edges_i.append(i)
                edges_j.append(j)
        if len(linked):
            while (root != root[root]).any():
                root = root[root]
    return np.array(edges_i, np.int64), np.array(edges_j, np.int64)


def across(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) between two blocks that join all rows linked between them; at most as many as rows."""
    root, out = np.arange(len(b)), []
    for i in range(len(a)):
        near = np.flatnonzero(np.bitwise_count(a[i] ^ b) <= most)
        if len(near):
            groups, first = np.unique(root[near], return_index=True)
            out += [(i, j) for j in near[first].tolist()]
            if len(groups) > 1:
                root[np.isin(root, groups)] = groups[0]
    return np.array([i for i, _ in out], np.int64), np.array([j for _, j in out], np.int64)


def within(key: np.ndarray, fp: np.ndarray, most: int, block: int, before: int) -> list[pa.RecordBatch]:
    """Forests of whole anchors (sorted), in blocks; ``before``: blocks of the first one that are done.

    Rows of the links have no part; anchors of several blocks also give their rows, with the block's number.
    """
    if not len(key):
        return []
    start = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
    size = np.diff(np.append(start, len(key)))
    part = (np.arange(len(key)) - np.repeat(start, size)) // block
    part[: size[0]] += before
    group = np.cumsum(np.diff(key, prepend=key[0]).astype(bool) | np.diff(part, prepend=part[0]).astype(bool))
    i, j = forest(group, fp, most)
    several = np.repeat(part[start + size - 1] > 0, size)
    out = [_rows(fp[i], fp[j], None, len(i))] if len(i) else []
    if several.any():
        out.append(_rows(key[several].astype(np.int64), fp[several], part[several], int(several.sum())))
    return out


def links(distinct: DataFrame, most: int = 4, block: int = 8192) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``fp``) that join all that are linked at all."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = GolayAnchors(-(-most // 2))
        for b in batches:
            all_fp = b.column(0).to_numpy()
            for lo in range(0, len(all_fp), 2048):
                fp = all_fp[lo : lo + 2048]
                row, anchor = anchors(fp, code)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int32)), pa.array(fp[row])], names=["anchor", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links within blocks of up to ``block`` rows of an anchor (part null), and the rows of anchors with
        more (anchor and number of the block)."""
        key, fp, done = np.zeros(0, np.int32), np.zeros(0, np.uint64), 0
        for b in batches:
            key = np.concatenate([key, b.column(0).to_numpy()])
            fp = np.concatenate([fp, b.column(1).to_numpy().view(np.uint64)])
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last anchor may go on
            if cut:
                yield from within(key[:cut], fp[:cut], most, block, done)
                key, fp, done = key[cut:], fp[cut:], 0
            while len(key) > block:
                i, j = forest(key[:block], fp[:block], most)
                if len(i):
                    yield _rows(fp[i], fp[j], None, len(i))
                yield _rows(key[:block].astype(np.int64), fp[:block], np.full(block, done), block)
                key, fp, done = key[block:], fp[block:], done + 1
        yield from within(key, fp, most, block, done)

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in zip(b.column(0), b.column(1), strict=True):
                u, v = (z.values.to_numpy().view(np.uint64) for z in (x, y))
                i, j = across(u, v, most)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(u[i].view(np.int64)), pa.array(v[j].view(np.int64))], names=["a", "b"])

    sent = distinct.select("fp").mapInArrow(replicate, "anchor int, fp long").repartition("anchor").sortWithinPartitions("anchor", "fp")
    found, _ = materialize(sent.mapInArrow(compare, "a long, b long, part int"), "simhash-links")
    near = found.where("part IS NULL").select("a", "b")
    blocks = found.where("part IS NOT NULL").groupBy(F.col("a").alias("anchor"), "part").agg(F.collect_list("b").alias("fps"))
    blocks = blocks.withColumn("parts", F.max("part").over(_window("anchor")))
    # block p meets every later block q once, in a task found by (anchor, p, q)
    mine = blocks.select("anchor", F.col("part").alias("p"), "fps", F.explode(F.sequence("part", "parts")).alias("q")).where("p < q")
    theirs = blocks.where("part > 0").select("anchor", F.col("part").alias("q"), F.col("fps").alias("others"), F.explode(F.sequence(F.lit(0), F.col("part") - 1)).alias("p"))
    pairs = mine.join(theirs, ["anchor", "p", "q"]).select("fps", "others")
    return near.union(pairs.mapInArrow(cross, "a long, b long")).distinct()


def _rows(a: np.ndarray, b: np.ndarray, part: np.ndarray | None, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.nulls(n, pa.int32()) if part is None else pa.array(part.astype(np.int32))], names=["a", "b", "part"])


def _window(*by: str):
    from pyspark.sql import Window

    return Window.partitionBy(*by)


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """``node, root``: every node of the links ``a, b`` with its component's smallest node.

    Alternating large-star and small-star (Kiveris et al. 2014); every round ends in a written table. Rounds grow with the logarithm of the longest
    chain; an unstable result is never returned.
    """
    spark = edges.sparkSession
    stars, path = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    before = None
    for _ in range(rounds):
        size = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if size == before:
            break
        before = size
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = dealt_join(both.where("v > u"), least, "u", ["v"], "n", 2 * size[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, large_path = materialize(large, "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = dealt_join(large, least, "u", ["v"], "n", 2 * size[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after, after_path = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        remove(spark, path)
        remove(spark, large_path)
        stars, path = after, after_path
    else:
        raise RuntimeError(f"components aren't stable after {rounds} rounds")
    nodes = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(stars.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def named(prints: DataFrame, distinct: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """``id_col, fp, component_id`` of every row of ``prints``; ``distinct``: ``fp, least`` (its smallest id) and ``n`` (its
    rows); ``found``: ``node, root`` of the linked ones."""
    spark = prints.sparkSession
    linked = distinct.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    linked, linked_path = materialize(linked, "linked-fingerprints")
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("of"))
    fps, rows = linked.agg(F.count("*"), F.sum("n")).first()
    names, _ = materialize(dealt_join(linked, ids, "root", ["fp"], "of", fps).select("fp", "n", "component_id"), "named-fingerprints")
    remove(spark, linked_path)
    return dealt_join(prints, names, "fp", [id_col], "n", rows or 0).select(id_col, "fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = 4, most: int = 4, block: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fingerprint string, component_id`` (the smallest id of all documents linked to it) per row."""
    spark = docs.sparkSession
    prints, _ = materialize(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct, distinct_path = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    found, found_path = materialize(components(links(distinct, most, block)), "components")
    rows = named(prints, distinct, found, id_col)
    for p in (distinct_path, found_path):
        remove(spark, p)
    return rows.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 4, most: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those of a larger id than another of their component. Rows of one id are one
    document and stay together; rows without an id stay."""
    gone = near_duplicates(docs, words, most, id_col=id_col, text_col=text_col).where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(docs.columns)
