"""Packing of token sequences by best-fit decreasing with a segment tree over remaining capacities.

A document longer than the window is first cut into full windows, which fill a sequence each; what is
left, like every shorter document, is a piece. Pieces are placed longest first, each into the tightest
open sequence that holds it: a segment tree indexed by remaining capacity counts the open sequences of
each capacity, and a descent finds the smallest capacity that is large enough. Only a piece that fits
nowhere opens a sequence.

Blocks. Best-fit decreasing needs its pieces sorted. They are sorted and packed within blocks of a task's
own rows (``block_tokens``, a memory bound: a block holds thousands of sequences, so the last, partly
filled ones weigh little). Nothing is shuffled, and a block depends on its input rows alone, so a task
that runs again packs alike. Sequence ids are the task's number and a running number.

Cases: null and empty texts yield the separator alone; repeated rows are packed each; ties in length go
by input order; a very long text is tokenized whole and cut into windows; other columns are not read; null doc_ids
pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import CACHE_ENTRIES, released, slices, text_or_empty
from .token_counts import RankMerger

#: Texts with these are left to the library: separators on which Python and it disagree, capital sigma (its
#: small letter depends on the place) and what may be an added token.
ODD = ["\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\u03a3", "<|"]
#: Fixed value: the pre-token pattern of the word tokenizer; what lies between matches is dropped.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Rows whose texts are Python strings at a time, and tokens of a batch that is given back (unless a piece is longer).
ROWS, BATCH_TOKENS = 2048, 1 << 19


class WordTokenizer:
    """Ids of texts under a lower-casing byte-level BPE with word ends, equal to the library's.

    Pre-tokens never cross white space and encode independently: new ones are merged together, rank by rank.
    Bounded caches hold the ids of pre-tokens and of the stretches between white space. Texts in another normal
    form than NFC, and those with odd or unassigned characters (whose kind differs between versions of Unicode), are
    left to the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.merger = RankMerger(path)
        self.words = regex.compile(PRE_TOKENS).findall
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.odd: set[str] = set()

    def _learn(self, new: list[str]) -> None:
        """Adds stretches to the cache."""
        self.odd.update(w for w in new if not w.isprintable() and any(unicodedata.category(c) == "Cn" for c in w))
        low = [w.lower() for w in new]  # may hold more than letters where the word does not
        cut = [[w] if w.isalpha() else self.words(w) for w in low]
        fresh = list(set().union(*cut).difference(self.pieces))
        ids, n = self.merger.merge([w.encode() for w in fresh])
        raw, end = ids.tobytes(), (4 * np.cumsum(n)).tolist()
        self.pieces.update((w, raw[a:b]) for w, a, b in zip(fresh, [0, *end], end, strict=False))
        get = self.pieces.__getitem__
        self.known.update((w, get(c[0]) if len(c) == 1 else b"".join(map(get, c))) for w, c in zip(new, cut, strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """int32 ids of each text, special tokens not added."""
        out = []
        for lo, hi in slices(texts):
            plain = [unicodedata.is_normalized("NFC", t) and not any(x in t for x in ODD) for t in texts[lo:hi]]
            parts = [t.split() if p else [] for t, p in zip(texts[lo:hi], plain, strict=True)]
            words = set().union(*parts)
            if len(self.known) > CACHE_ENTRIES or len(self.pieces) > CACHE_ENTRIES:
                self.known, self.pieces, self.odd = {}, {}, set()
            self._learn(list(words.difference(self.known)))
            get = self.known.__getitem__
            for t, p, ws in zip(texts[lo:hi], plain, parts, strict=True):
                p = p and (not self.odd or self.odd.isdisjoint(ws))
                out.append(np.frombuffer(b"".join(map(get, ws)), np.int32) if p else np.array(self.library.encode(t, add_special_tokens=False).ids, np.int32))
        return out


class OpenSequences:
    """Open sequences by remaining capacity: a segment tree of counts, and the sequences at each leaf."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, sequence: int) -> None:
        self.at[capacity].append(sequence)
        self._change(capacity, 1)

    def _change(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Takes out an open sequence of the least capacity of ``size`` or more: (capacity, sequence)."""
        count, node = self.count, size + self.leaves
        if not count[node]:
            # climb until a subtree to the right has one, then keep left on the way down
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._change(capacity, -1)
        return capacity, self.at[capacity].pop()


def best_fit(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of every piece (each of 1 to ``window`` tokens), and the number of sequences."""
    order = np.argsort(-sizes, kind="stable")
    sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    open_, n = OpenSequences(window), 0
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        found = open_.tightest(size)
        if found is None:
            found = window, n
            n += 1
        room, sequence[i] = found
        offset[i] = window - room
        if room > size:
            open_.add(room - size, found[1])
    return sequence, offset, n


def pack(docs: DataFrame, tokenizer: str, separator: int, window: int = 2048, block_tokens: int = 1 << 23, ids: str = "list", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: ``id_col, start, length, doc_tokens, sequence_id, offset`` and its tokens.

    The tokens come as ``token_ids array<int>``, or with ``ids='crc32'`` as ``ids_crc32 long`` of their
    little-endian unsigned 32-bit form. Every document ends with ``separator``.
    """
    if window < 1 or block_tokens < window:
        raise ValueError("window must be at least 1 and block_tokens at least window")
    kind = docs.schema[id_col].dataType.simpleString()
    last = ("ids_crc32", pa.int64(), "long") if ids == "crc32" else ("token_ids", pa.list_(pa.int32()), "array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordTokenizer(tokenizer)
        end = np.array([separator], np.int32)
        base = TaskContext.get().partitionId() << 36
        names, tokens, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base
            sizes = np.array([len(t) for t in tokens], np.int64)
            n = -(-sizes // window)
            doc = np.repeat(np.arange(len(sizes)), n)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * window
            length = np.minimum(sizes[doc] - start, window)
            sequence, offset, made = best_fit(length, window)
            keys = pa.concat_arrays(names)
            ends = np.append(0, np.cumsum(length))
            hi = 0
            while hi < len(doc):  # batches are bounded by tokens too: both sides hold them whole
                lo = hi
                hi = max(lo + 1, min(lo + 20_000, int(np.searchsorted(ends, ends[lo] + BATCH_TOKENS, "right")) - 1))
                cut = [tokens[d][s : s + k] for d, s, k in zip(doc[lo:hi].tolist(), start[lo:hi].tolist(), length[lo:hi].tolist(), strict=True)]
                if ids == "crc32":
                    value = pa.array([zlib.crc32(c.astype("<u4").tobytes()) for c in cut], last[1])
                else:
                    value = pa.ListArray.from_arrays(pa.array((ends[lo : hi + 1] - ends[lo]).astype(np.int32)), pa.array(np.concatenate(cut)))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(doc[lo:hi])), *map(pa.array, (start[lo:hi], length[lo:hi], sizes[doc[lo:hi]], base + sequence[lo:hi], offset[lo:hi])), value], names=[id_col, "start", "length", "doc_tokens", "sequence_id", "offset", last[0]])
            base += made

        for b in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            texts = b.column(1).to_pylist()
            for lo, hi in slices(texts):
                got = [np.concatenate([x, end]) for x in coder.encode(texts[lo:hi])]
                names.append(b.column(0).slice(lo, hi - lo))
                tokens += got
                held += sum(map(len, got))
                if held >= block_tokens:
                    yield from flush()
                    names, tokens, held = [], [], 0
        if tokens:
            yield from flush()

    return docs.select(id_col, text_or_empty(text_col)).mapInArrow(released(run), f"`{id_col}` {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, {last[0]} {last[2]}")
