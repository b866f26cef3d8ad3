"""Fill-in-the-middle transformation over a distinct-text index.

Identical texts are brought together by their digest and their contents compared; each distinct text gets one
Elias-Fano list of the byte offsets at which its code points begin. Every document of that text is then joined to the
list and selects its own seeded cut from it: no document counts code points for itself.

A text crosses the network once. Documents are exchanged by (digest, part) and sorted, so an entry and its documents
meet as neighbours in a task, which holds one entry at a time. ``part`` is 0 but for texts that very many documents hold: their
documents are dealt over several parts, each with its own copy of the entry. Which texts these are comes from a count of
digests; there are fewer than ``most_hot`` of them at any size, since they hold more than 1 / ``most_hot`` of all documents
each, so their digests (32 bytes) are broadcast.

Cases: null and empty texts are plain; so are texts that hold a sentinel. Ids that are null take the seed's text alone.
Repeated rows give repeated results; two texts of one digest would have an entry each; other columns
of the input are not read; an empty table gives an empty result; a long text has two bits or a little more a byte in its list.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, text_or_empty

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes of a list's upper half for which one count of ones is kept.
SAMPLE = 64
#: Bytes of a text that are looked at together while its list is made.
STEP = 1 << 20


class Boundaries:
    """The offsets at which the code points of a UTF-8 text begin, and its end, as an Elias-Fano list: the low bits of
    each packed, the high bits in unary, with a count of ones every ``SAMPLE`` bytes."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        first = lambda lo: (raw[lo : lo + STEP] & 0xC0) != 0x80
        self.n = sum(int(np.count_nonzero(first(lo))) for lo in range(0, len(raw), STEP))
        self.low_bits = max(0, (len(raw) // (self.n + 1)).bit_length() - 1)
        high = np.zeros((len(raw) >> self.low_bits) + self.n + 1, np.uint8)
        low = np.zeros((self.n + 1, self.low_bits), np.uint8)
        at = 0
        for lo in [*range(0, len(raw), STEP), None]:
            places = np.array([len(raw)]) if lo is None else np.flatnonzero(first(lo)) + lo
            high[(places >> self.low_bits) + np.arange(at, at + len(places))] = 1
            for k in range(self.low_bits):
                low[at : at + len(places), k] = places >> k & 1
            at += len(places)
        self.high, self.low = np.packbits(high, bitorder="little"), np.packbits(low.ravel(), bitorder="little")
        ones = np.add.reduceat(np.bitwise_count(self.high).astype(np.int64), np.arange(0, len(self.high), SAMPLE))
        self.before = np.cumsum(ones) - ones

    def __getitem__(self, k: int) -> int:
        """The byte offset of code point ``k``; that of the end for ``n``."""
        block = int(np.searchsorted(self.before, k, "right")) - 1
        bits = np.unpackbits(self.high[block * SAMPLE : (block + 1) * SAMPLE], bitorder="little")
        place = int(np.flatnonzero(bits)[k - self.before[block]]) + block * SAMPLE * 8
        value = (place - k) << self.low_bits
        for j in range(self.low_bits):
            bit = k * self.low_bits + j
            value |= (int(self.low[bit >> 3]) >> (bit & 7) & 1) << j
        return value


def draws(seed: int, doc_id) -> list[int]:
    """Four 32-bit numbers of a document."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def arranged(data: bytes, form: str, a: int, b: int) -> bytes:
    """The output of a form for the text's bytes, cut at bytes ``a`` and ``b``."""
    if form == "plain":
        return data
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle) if form == "psm" else (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))


def restored(output: bytes, form: str) -> bytes:
    """The text that an output of this form was made of."""
    if form == "plain":
        return output
    one, two = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    head, _, rest = output.removeprefix(one).partition(two)
    tail, _, middle = rest.partition(MIDDLE)
    return head + middle + tail if form == "psm" else tail + middle + head


def transform(docs: DataFrame, seed: int = 1, plain: int = 10, spm: int = 20, outputs: tuple[str, ...] = ("output",), part_rows: int = 1000, most_hot: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n`` (code points), ``form`` (plain, psm or spm), ``prefix_chars, middle_chars`` (null if plain) and
    ``outputs``: any of ``output``, ``restored`` (the text rebuilt from output and form) and their ``_sha256``.

    ``plain`` and ``spm`` are percentages, of all documents and of those that are not plain.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, entries = None, []
        for b in batches:
            all_texts = b.column(2).to_pylist()
            for lo, hi in slices(all_texts, 1 << 22):
                rows = []
                for doc_id, digest, text in zip(b.column(0).slice(lo, hi - lo).to_pylist(), b.column(1).slice(lo, hi - lo).to_pylist(), all_texts[lo:hi], strict=True):
                    if digest != key:
                        key, entries = digest, []
                    entry = next((e for e in entries if e[0] == text), None)
                    if entry is None:
                        data = text.encode()
                        entry = (text, data, Boundaries(data), any(s in data for s in (PREFIX, SUFFIX, MIDDLE)))
                        entries.append(entry)
                    _, data, places, marked = entry
                    h1, h2, h3, h4 = draws(seed, doc_id)
                    form = "plain" if not data or marked or h3 % 100 >= 100 - plain else "spm" if h4 % 100 < spm else "psm"
                    i, j = sorted((h1 % (places.n + 1), h2 % (places.n + 1)))
                    out = arranged(data, form, places[i], places[j])
                    back = restored(out, form) if {"restored", "restored_sha256"} & {*outputs} else b""
                    made = {
                        "output": lambda out=out: out.decode(),
                        "restored": lambda back=back: back.decode(),
                        "output_sha256": lambda out=out: hashlib.sha256(out).hexdigest(),
                        "restored_sha256": lambda back=back: hashlib.sha256(back).hexdigest(),
                    }
                    rows.append((places.n, form, *((None, None) if form == "plain" else (i, j - i)), *(made[o]() for o in outputs)))
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * len(outputs)]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *columns], names=[id_col, "n", "form", "prefix_chars", "middle_chars", *outputs])

    rows = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text")).withColumn("__key", F.unhex(F.sha2(F.col("__text").cast("binary"), 256)))
    counts = rows.groupBy("__key").agg(F.count("*").alias("__n"))
    least = F.greatest(F.lit(part_rows), F.ceil(F.lit(docs.count()) / most_hot))
    hot, _ = materialize(counts.where(F.col("__n") > least).select("__key", F.ceil(F.col("__n") / least).alias("__parts")), "fill-middle-hot-texts")
    rows = rows.join(F.broadcast(hot), "__key", "left")  # fewer than most_hot rows of 40 bytes
    rows = rows.withColumn("__part", F.pmod(F.xxhash64("__id"), F.coalesce("__parts", F.lit(1))))
    sent = rows.repartition("__key", "__part").sortWithinPartitions("__key", "__part").select("__id", "__key", "__text")
    return sent.mapInArrow(run, ", ".join([f"`{id_col}` {kind}, n long, form string, prefix_chars long, middle_chars long", *(f"{o} string" for o in outputs)]))
