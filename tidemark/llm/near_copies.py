"""Near copies by SimHash: anchors of a covering code find candidates, the exact similarity of word shingles decides.

Two documents are near copies if the Jaccard similarity of their sets of word shingles is ``least`` or more.

Fingerprints. As in ``simhash``, every shingle's hash votes on the bits. At similarity 0.8 a bit differs with probability
0.15 (0.19 at most, in sets of four and five shingles, of which 2 in 10,000 pairs meet nowhere), 10 of 64: too many for one word of a fingerprint to tell. So a fingerprint is
``WORDS`` words, each voted on by an independent mix of the hashes; the first takes the hashes themselves.

Candidates. A word has two halves of 23 bits, and a half is sent to all of its Golay code's anchors within the covering
radius and one bit more (5.3 of 4096 a half). Sets that share an anchor of a half are compared by the first ``CHECKED`` words: those
at most ``NEAR`` bits apart are candidates. Sets of similarity 0.8 share an anchor of a given half with probability 0.6, so of such pairs
about 3 in a million meet nowhere; unrelated sets are candidates with probability 1e-8. An anchor is compared in blocks;
anchors of several blocks (large groups of near copies) have each two of them compared in a row of its own.

Verification. Sets that candidates join form a group. Each group is dealt to blocks of about ``block`` sets
by hash; every block, and every pair of blocks of a group, is compared exactly in a row of its own. No pair of a
group is left out; the work grows with the square of a candidate group's blocks.

Equal sets are merged before. Groups of near copies are the components of the verified pairs.

Cases: words and letters as in ``simhash``; fewer words than a shingle give one shingle; null and empty texts have
the empty set and are copies of each other; rows of one id are one document; rows without an id neither go nor
make others go; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, released, remove, text_or_empty
from .simhash import SEED, GolayAnchors, components, named

#: Words of a fingerprint, those by which candidates are compared, and the bits that these differ in at most (all, and the first two).
WORDS, CHECKED, NEAR, NEAR_TWO = 7, 3, 57, 46
#: Sets of an anchor that are compared at a time, and comparisons held at a time.
ANCHOR_BLOCK, CELLS = 1 << 15, 1 << 18
#: Bytes of sets (8 a distinct shingle) that a block holds, but for one set that is longer alone.
BLOCK_BYTES = 16 << 20


def shingles(text: str, words: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 of a text's word shingles."""
    parts = text.encode().lower().split()
    n = max(1, len(parts) - words + 1) if parts else 0
    hash_ = xxhash.xxh64_intdigest
    return np.unique(np.array([hash_(b" ".join(parts[i : i + words]), SEED) for i in range(n)], np.uint64))


def fingerprint(found: np.ndarray) -> np.ndarray:
    """The SimHash of a set of hashes, ``WORDS`` words; a bit is set if over half of the hashes, mixed by the word's number, set it."""
    votes = np.zeros(64 * WORDS, np.int64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(found), 1 << 14):
            part = found[lo : lo + (1 << 14)]
            h = part + (np.arange(1, WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
            for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
            h = np.concatenate([part[None], h ^ (h >> np.uint64(31))]).T
            bits = np.unpackbits(np.ascontiguousarray(h, "<u8").view(np.uint8), axis=1, bitorder="little")
            for at in range(0, len(bits), 255):  # no count of so many exceeds a byte
                votes += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return np.packbits(votes * 2 > len(found), bitorder="little").view("<u8")


def anchors(words: np.ndarray, code: GolayAnchors) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor with the number of its half) of all anchors that fingerprints (a row each) are sent to."""
    rows, keys = [], []
    for half in range(2 * WORDS):
        row, anchor, _ = code.near((words[:, half // 2] >> np.uint64(half % 2 * 23) & np.uint64(0x7FFFFF)).astype(np.int64))
        rows.append(row)
        keys.append(anchor | half << 12)
    return np.concatenate(rows), np.concatenate(keys)


def joined(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of fingerprints (a column each) that join all that are ``NEAR`` bits apart or less; fewer than fingerprints."""
    n = words.shape[1]
    order, root, out = np.arange(n), np.arange(n), []

    def meet(mine: slice, theirs: slice) -> None:
        x, y = words[:, mine], words[:, theirs]
        far = np.bitwise_count(x[0][:, None] ^ y[0])
        far += np.bitwise_count(x[1][:, None] ^ y[1])
        i, j = np.nonzero(far <= NEAR_TWO)
        apart = root[mine][i] != root[theirs][j]
        i, j = i[apart], j[apart]
        near = np.bitwise_count(x[:, i] ^ y[:, j]).sum(0) <= NEAR
        i, j = i[near] + mine.start, j[near] + theirs.start
        for k, at in zip(*np.unique(i, return_index=True), strict=True):
            others = j[at : np.searchsorted(i, k, "right")]
            others = others[root[others] != root[k]]
            if len(others):
                groups, first = np.unique(root[others], return_index=True)
                out.extend((order[k], order[o]) for o in others[first])
                root[np.isin(root, groups)] = root[k]

    if n > 256:  # what one of a few joins to a large group needn't meet within it
        for k in range(0, n, -(-n // 16)):
            meet(slice(k, k + 1), slice(0, n))
        order = np.argsort(root, kind="stable")
        words, root = words[:, order], root[order]
    end = np.searchsorted(root, root, "right")
    several = np.append(np.flatnonzero(end - np.arange(n) > 1), n)
    lo = 0
    while lo < n:
        # rows of one group meet what lies behind it, rows of none all that follows
        step = lo + max(1, CELLS // n)
        alone = several[np.searchsorted(several, lo)] > lo
        hi = min(step, several[np.searchsorted(several, lo)]) if alone else min(step, end[lo])
        theirs = slice(lo if alone else int(end[lo]), n)
        if theirs.start < n:
            meet(slice(lo, int(hi)), theirs)
        lo = int(hi)
    return tuple(np.array([p[s] for p in out], np.int64) for s in (0, 1))


def digest(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63)


def similar(a: list[np.ndarray], b: list[np.ndarray] | None, least: Fraction) -> list[tuple[int, int]]:
    """Pairs (i, j) of sets of ``a`` and of ``b`` (or within ``a``) that join all whose similarity is ``least``
    or more; no more than as many as sets."""
    both = a if b is None else a + b
    size = np.array([len(s) for s in both], np.int64)
    ids = np.unique(np.concatenate(both), return_inverse=True)[1] if size.sum() else np.zeros(0, np.int64)
    start = np.cumsum(size) - size
    first = 0 if b is None else len(a)
    rest, from_ = ids[start[first] :], start[first:] - start[first]
    has, root, out = np.zeros(len(ids), bool), np.arange(len(both)), []
    for i in range(len(a)):
        mine = ids[start[i] : start[i] + size[i]]
        has[mine] = True
        total = np.concatenate([[0], np.cumsum(has[rest])])
        common = total[from_ + size[first:]] - total[from_]
        has[mine] = False
        near = np.flatnonzero(common * least.denominator >= least.numerator * (size[i] + size[first:] - common)) + first
        if b is None:
            near = near[near > i]
        near = near[root[near] != root[i]]
        if len(near):
            groups, at = np.unique(root[near], return_index=True)
            out += [(i, j - first) for j in near[at].tolist()]
            root[np.isin(root, groups)] = root[i]
    return out


def candidates(distinct: DataFrame, block: int = ANCHOR_BLOCK) -> DataFrame:
    """``a, b``: pairs of sets (``fp``, with the words of their fingerprints) that join all candidates."""
    checked = [f"w{k}" for k in range(CHECKED)]

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = GolayAnchors(1)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                words = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u8").reshape(-1, WORDS)
                row, anchor = anchors(words, code)
                held = [pa.array(words[row, k].view(np.int64)) for k in range(CHECKED)]
                yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int32)), part.column(0).take(pa.array(row)), *held], names=["anchor", "fp", *checked])

    def edges(fp: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
        i, j = joined(words)
        return pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[j]), pa.nulls(len(i), pa.int32()), pa.nulls(len(i), pa.binary())], names=["a", "b", "part", "words"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidates within blocks (part null), and the sets of anchors of several blocks (anchor, set, block)."""
        key, fp, words, done = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((CHECKED, 0), np.uint64), 0

        def first(n: int, more: bool) -> Iterator[pa.RecordBatch]:
            """The first ``n`` rows, of one anchor, are a block; ``more``: others of the anchor follow."""
            nonlocal key, fp, words, done
            if n > 1:
                yield edges(fp[:n], words[:, :n])
            if done or more:
                raw = [w.tobytes() for w in np.ascontiguousarray(words[:, :n].T)]
                yield pa.RecordBatch.from_arrays([pa.array(key[:n]), pa.array(fp[:n]), pa.array(np.full(n, done, np.int32)), pa.array(raw, pa.binary())], names=["a", "b", "part", "words"])
            key, fp, words, done = key[n:], fp[n:], words[:, n:], done + 1 if more else 0

        for b in batches:
            key = np.concatenate([key, b.column(0).to_numpy().astype(np.int64)])
            fp = np.concatenate([fp, b.column(1).to_numpy()])
            words = np.concatenate([words, np.stack([b.column(2 + k).to_numpy().view(np.uint64) for k in range(CHECKED)])], axis=1)
            while len(key) and (key[0] != key[-1] or len(key) > block):  # the last anchor may go on
                n = int(np.searchsorted(key, key[0], "right"))
                yield from first(min(n, block), n > block)
        while len(key):
            n = int(np.searchsorted(key, key[0], "right"))
            yield from first(min(n, block), n > block)

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one, two in zip(b.column(0), b.column(1), strict=True):
                both = one.as_py() + two.as_py()
                words = np.frombuffer(b"".join(s["words"] for s in both), np.uint64).reshape(-1, CHECKED).T
                yield edges(np.array([s["b"] for s in both], np.int64), np.ascontiguousarray(words)).select(["a", "b"])

    sent = distinct.where("words IS NOT NULL").select("fp", "words").mapInArrow(released(replicate), "anchor int, fp long, " + ", ".join(f"{w} long" for w in checked))
    found, _ = materialize(sent.repartition("anchor").sortWithinPartitions("anchor", "fp").mapInArrow(released(compare), "a long, b long, part int, words binary"), "near-copy-links")
    blocks = found.where("part IS NOT NULL").groupBy(F.col("a").alias("anchor"), "part").agg(F.collect_list(F.struct("b", "words")).alias("sets"))
    blocks = blocks.join(blocks.groupBy("anchor").agg(F.max("part").alias("last")), "anchor")
    mine = blocks.where("part < last").select("anchor", F.col("part").alias("p"), "sets", F.explode(F.sequence(F.col("part") + 1, F.col("last"))).alias("q"))
    theirs = blocks.where("part > 0").select("anchor", F.col("part").alias("q"), F.col("sets").alias("others"), F.explode(F.sequence(F.lit(0), F.col("part") - 1)).alias("p"))
    pairs = mine.join(theirs, ["anchor", "p", "q"]).select("sets", "others")
    return found.where("part IS NULL").select("a", "b").union(pairs.mapInArrow(released(cross), "a long, b long")).distinct()


def links(docs: DataFrame, distinct: DataFrame, words: int, least: Fraction, block: int, id_col: str, text_col: str) -> DataFrame:
    """``a, b``: verified pairs of sets (by digest) that join all near copies among the candidates."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t.as_py(), words) for t in b.column(0)]
            same = [k for k, (s, fp) in enumerate(zip(found, b.column(1).to_pylist(), strict=True)) if digest(s) == fp]
            some = b.take(pa.array(same, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(1), some.column(2), some.column(3), pa.array([found[k].tobytes() for k in same], pa.binary())], names=["fp", "root", "part", "shingles"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                one, two = (c[r].as_py() for c in (batch.column(0), batch.column(1)))
                x = [np.frombuffer(s["shingles"], np.uint64) for s in one]
                y = None if two is None else [np.frombuffer(s["shingles"], np.uint64) for s in two]
                pairs = similar(x, y, least)
                if pairs:
                    other = one if two is None else two
                    yield pa.RecordBatch.from_arrays([pa.array([one[i]["fp"] for i, _ in pairs], pa.int64()), pa.array([other[j]["fp"] for _, j in pairs], pa.int64())], names=["a", "b"])

    loose, _ = materialize(components(candidates(distinct)), "near-copy-candidates")
    # a block holds about ``block`` sets and BLOCK_BYTES, so sets of very long texts are few to a block
    sized = loose.join(distinct.select(F.col("fp").alias("node"), F.col("least").alias(id_col), "bytes"), "node")
    most = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("bytes") / BLOCK_BYTES))
    parts = sized.groupBy("root").agg(most.cast("int").alias("parts"))
    chosen = sized.join(parts, "root")
    chosen = chosen.select(id_col, F.col("node").alias("fp"), "root", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    read = docs.select(id_col, text_or_empty(text_col)).join(chosen, id_col).select(text_col, "fp", "root", "part")
    held = read.mapInArrow(released(sets), "fp long, root long, part int, shingles binary").groupBy("root", "part", "fp").agg(F.first("shingles").alias("shingles"))
    blocks, _ = materialize(held.groupBy("root", "part").agg(F.collect_list(F.struct("fp", "shingles")).alias("sets")), "near-copy-blocks")
    blocks = blocks.join(blocks.groupBy("root").agg(F.max("part").alias("last")), "root")
    kind = blocks.schema["sets"].dataType
    alone = blocks.select("sets", F.lit(None).cast(kind).alias("others"))
    mine = blocks.where("part < last").select("root", F.col("part").alias("p"), "sets", F.explode(F.sequence(F.col("part") + 1, F.col("last"))).alias("q"))
    theirs = blocks.where("part > 0").select("root", F.col("part").alias("q"), F.col("sets").alias("others"), F.explode(F.sequence(F.lit(0), F.col("part") - 1)).alias("p"))
    pairs = mine.join(theirs, ["root", "p", "q"]).select("sets", "others")
    return alone.union(pairs).mapInArrow(released(verify), "a long, b long").distinct()


def groups(docs: DataFrame, words: int = 5, least: Fraction = Fraction(4, 5), block: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, component_id`` (the smallest id of its group of near copies) of every row with an id."""
    docs = docs.where(F.col(id_col).isNotNull())
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t.as_py(), words) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([digest(s) for s in found], pa.int64()), pa.array([fingerprint(s).tobytes() if len(s) else None for s in found], pa.binary()), pa.array([s.nbytes for s in found], pa.int64())], names=[id_col, "fp", "words", "bytes"])

    prints, prints_path = materialize(docs.select(id_col, text_or_empty(text_col)).mapInArrow(released(run), f"`{id_col}` {kind}, fp long, words binary, bytes long"), "shingle-sets")
    distinct, distinct_path = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n"), F.max("bytes").alias("bytes"), F.max("words").alias("words")), "distinct-sets")
    found, found_path = materialize(components(links(docs, distinct, words, least, block, id_col, text_col)), "near-copy-components")
    out = named(prints.select(id_col, "fp"), distinct, found, id_col)
    remove(docs.sparkSession, distinct_path)
    remove(docs.sparkSession, found_path)
    return out.select(id_col, "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents without those of a larger id than another of their group."""
    gone = groups(docs, id_col=id_col, text_col=text_col, **how).where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(docs.columns)
