"""Quartile bucket digests: fingerprints of whole texts that say how alike two texts are.

Every byte of a text begins three triplets within a window of five bytes (zeros follow the last), those whose bytes don't
adjoin: they tell texts of one language apart better than neighbouring bytes do. Each is hashed into one of 1024 buckets. A digest holds, for every bucket, the quartile of the bucket counts that its count lies in (two bits), the
first two quartiles as shares of the third, and the logarithm of the length. Two digests differ by a bounded sum over
these; likeness is 1 for equal digests and falls to 0 where they differ as much as those of unrelated texts.

``edited`` compares every document with a text made of it and its successor. Rows are exchanged once, by ranges of
(id, hash of the text), and sorted; a task walks its range and holds two texts. What lies across two ranges is finished from
a written table with the first and the last row of each task.

Cases: a null text is an empty one, whose digest has zeros; null ids come last; rows of one id are ordered by their text's
hash, then by text, so repeated rows follow one another; other columns of the input are not read; an empty table gives an
empty result; a long text is counted in steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices, text_or_empty

BUCKETS = 1024
#: Places of the bytes of a window's triplets, the window's first byte in each.
TRIPLETS = ((0, 1, 4), (0, 2, 4), (0, 3, 4))
#: Odd multipliers of a triplet's bytes, its kind and the sum.
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)
#: Bytes that are counted together.
STEP = 1 << 16
#: Length codes are this many to a doubling; a difference of more counts like this one.
LENGTH_STEPS, MOST_LENGTH = 8, 96
#: The difference at which nothing is alike: what the buckets of unrelated texts differ by, on average.
UNLIKE = 1.25 * BUCKETS


def triplet_counts(parts: list[tuple[bytes, int]]) -> np.ndarray:
    """Counts by bucket, a row for each part: of the triplets that begin in its first so many bytes.

    Parts are laid end to end, zeros between them, and counted together; long ones in steps."""
    out = np.zeros((len(parts), BUCKETS), np.int64)
    steps = [(i, data[lo : lo + min(STEP, n - lo) + 4], min(STEP, n - lo)) for i, (data, n) in enumerate(parts) for lo in range(0, n, STEP)]
    first = 0
    while first < len(steps):
        last, size = first, 0
        while last < len(steps) and size < STEP:
            size += steps[last][2]
            last += 1
        group = steps[first:last]
        x = np.frombuffer(b"".join(d + bytes(n + 4 - len(d)) for _, d, n in group), np.uint8)
        # every part's own row, and one more for the four bytes that follow it
        begins = np.array([n for _, _, n in group])
        row = np.repeat(np.tile([0, 1], len(group)), np.stack([begins, np.full(len(group), 4)], axis=1).ravel())
        row = np.where(row == 1, len(group), np.repeat(np.arange(len(group)), begins + 4)) * BUCKETS
        x, m = x.astype(np.uint32), len(x) - 4
        one, two, three = x[:m] * FACTORS[0], x * FACTORS[1], x * FACTORS[2]
        counts = np.zeros((len(group) + 1) * BUCKETS, np.int64)
        for kind, (_, j, k) in enumerate(TRIPLETS):
            mixed = one + two[j : j + m] + three[k : k + m] + FACTORS[3] * np.uint32(kind + 1)
            mixed ^= mixed >> np.uint32(15)
            mixed *= FACTORS[4]
            counts += np.bincount((mixed >> np.uint32(22)) + row[:m], minlength=len(counts))
        np.add.at(out, [i for i, _, _ in group], counts.reshape(-1, BUCKETS)[:-1])
        first = last
    return out


def encoded(counts: np.ndarray, n_bytes: int) -> bytes:
    """The digest of a text's bucket counts: length code, quartile shares, two bits a bucket."""
    q1, q2, q3 = (int(q) for q in np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]])
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    pairs = codes.reshape(-1, 4) << np.array([6, 4, 2, 0], np.uint8)
    length = min(255, round(LENGTH_STEPS * float(np.log2(n_bytes + 1))))
    return bytes([length, 16 * q1 // (q3 + 1) << 4 | 16 * q2 // (q3 + 1)]) + pairs.sum(1, dtype=np.uint8).tobytes()


def fingerprint(data: bytes) -> bytes:
    return encoded(triplet_counts([(data, len(data))])[0], len(data))


def difference(a: bytes, b: bytes) -> float:
    """0 for equal digests, bounded: buckets count by quartiles apart, shares and length by steps apart."""
    x, y = (np.frombuffer(d, np.uint8, offset=2) for d in (a, b))
    total = 0
    for shift in (0, 2, 4, 6):
        total += int(np.abs((x >> shift & 3).astype(np.int8) - (y >> shift & 3).astype(np.int8)).sum())
    shares = abs((a[1] >> 4) - (b[1] >> 4)) + abs((a[1] & 15) - (b[1] & 15))
    return total + shares + min(abs(a[0] - b[0]), MOST_LENGTH)


def likeness(a: bytes, b: bytes) -> float:
    return max(0.0, 1.0 - difference(a, b) / UNLIKE)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fingerprint`` (hex) of every row. One narrow pass."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in slices(texts):
                data = [t.encode() for t in texts[lo:hi]]
                made = [encoded(c, len(d)).hex() for c, d in zip(triplet_counts([(d, len(d)) for d in data]), data, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(made, pa.string())], names=[id_col, "fingerprint"])

    return docs.select(id_col, text_or_empty(text_col)).mapInArrow(run, f"`{id_col}` {kind}, fingerprint string")


def compared(pairs: DataFrame, left: str, right: str, to: str = "near") -> DataFrame:
    """``pairs`` and the likeness of two columns of fingerprints; null where one is."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in (left, right)), strict=True)
            near = [None if x is None or y is None else likeness(bytes.fromhex(x), bytes.fromhex(y)) for x, y in both]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.float64())], names=[*b.schema.names, to])

    return pairs.mapInArrow(run, f"{fields}, `{to}` double")


RESULT = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


class Text:
    """A document on the walk: its bytes on either side of its last third, and the counts of what an edit leaves alone."""

    def __init__(self, doc_id, text: str):
        self.id, self.text, self.third = doc_id, text, len(text) // 3
        cut = len(text) - self.third
        self.head, self.tail = text[:cut].encode(), text[cut:].encode()
        # triplets that begin more than four bytes before the cut are the same in both texts
        self.same = max(0, len(self.head) - 4)

    def parts(self) -> list[tuple[bytes, int]]:
        own = self.head[self.same :] + self.tail
        return [(self.head, self.same), (own, len(own))]

    def counted(self, same: np.ndarray, rest: np.ndarray) -> None:
        self.counts, self.print = same, encoded(same + rest, len(self.head) + len(self.tail))

    def beginning(self, follower: Text) -> bytes:
        return follower.text[: self.third].encode()


def against(pairs: list[tuple[Text, Text]]) -> list[tuple]:
    """The result columns of counted documents, given the next of each; digests as bytes, half as long as in hex."""
    new = [a.beginning(b) for a, b in pairs]
    rests = triplet_counts([(d, len(d)) for d in (a.head[a.same :] + n for (a, _), n in zip(pairs, new, strict=True))])
    out = []
    for (a, b), n, rest in zip(pairs, new, rests, strict=True):
        whole = encoded(a.counts + rest, len(a.head) + len(n))
        out.append((len(a.text), hashlib.sha256(a.head + n).digest(), a.print, whole, likeness(a.print, whole), likeness(a.print, b.print)))
    return out


def counted(rows: list[tuple]) -> list[Text]:
    """Documents of (id, text) rows, counted together."""
    texts = [Text(*r) for r in rows]
    counts = triplet_counts([p for t in texts for p in t.parts()])
    for k, t in enumerate(texts):
        t.counted(counts[2 * k], counts[2 * k + 1])
    return texts


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``: a document against
    itself with its last third replaced by the beginning of the next document, and against that one.

    Documents are taken by descending id; the first follows the last.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    names = ["part", "place", "id", "text", *(c.split()[0] for c in RESULT.split(", "))]
    id_type: dict = {}

    def table(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int32(), pa.int32(), id_type["id"], pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per document but the last (place 0), and the task's first and last documents (1 and 2)."""
        part, before = TaskContext.get().partitionId(), None
        for b in batches:
            id_type["id"] = b.column(0).type
            ids, values = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in slices(values, 1 << 18):
                texts = counted(list(zip(ids[lo:hi], values[lo:hi], strict=True)))
                rows = [] if before else [(part, 1, texts[0].id, texts[0].text, *[None] * 6)]
                chain = [before, *texts] if before else texts
                rows += [(part, 0, a.id, None, *made) for a, made in zip(chain[:-1], against(list(zip(chain[:-1], chain[1:], strict=True))), strict=True)]
                before = chain[-1]
                if rows:
                    yield table(rows)
        if before is not None:
            yield table([(part, 2, before.id, before.text, *[None] * 6)])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            id_type["id"] = b.column(0).type
            for doc_id, text, after in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield table([(0, 0, doc_id, None, *against([tuple(counted([(doc_id, text), (None, after)]))])[0])])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    order = [F.desc_nulls_last("id"), F.asc("h"), F.asc("text")]
    schema = f"part int, place int, id {kind}, text string, {RESULT}"
    walked, _ = materialize(rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order).select("id", "text").mapInArrow(walk, schema), "digest-walk")
    ends = walked.where("place = 2").select("part", "id", "text")
    firsts = walked.where("place = 1").select(F.col("part").alias("next"), F.col("text").alias("after"))
    # a row a task: the tasks' numbers in order, the first after the last
    w = Window.orderBy("part")
    follows = ends.select("part").withColumn("next", F.coalesce(F.lead("part").over(w), F.first("part").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    across = ends.join(follows, "part").join(firsts, "next").select("id", "text", "after").mapInArrow(close, schema)
    result = [F.col("id").alias(id_col), "n_chars", *(F.lower(F.hex(c)).alias(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), "near_edited", "near_next"]
    return walked.where("place = 0").select(*result).unionByName(across.select(*result))
