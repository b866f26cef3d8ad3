"""Token counts of a byte-level BPE by rank-synchronous array merging.

Distinct pre-tokens of a slice of texts are held as one ragged numpy array of symbols. Every round
finds each sequence's lowest-rank pair and merges all its occurrences at once, in all sequences
together; a sequence leaves the array when no pair of it has a rank. The surviving symbols are the
count. Counts of pre-tokens seen before come from a bounded per-worker cache.

Cases: a null or empty text has 0 bytes and 0 tokens; strings of added special tokens inside a text
count one token each, as the tokenizers library treats them by default; repeated rows give repeated
results; other columns of the input are not read; null doc_ids pass through; an empty table gives an
empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import CACHE_ENTRIES, slices, text_or_empty

NO_RANK = np.int64(1) << 40


def byte_alphabet() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    spare = iter(range(256, 512))
    return [out.get(b) or chr(next(spare)) for b in range(256)]


class RankMerger:
    """Merges of one tokenizer file as sorted arrays; many byte sequences are merged at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int64), made[order]
        self.base = np.array([vocab[c] for c in byte_alphabet()], np.int64)
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.last = np.array([vocab[c + suffix] for c in byte_alphabet()], np.int64)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]

    def _pairs(self, sym: np.ndarray, seq: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the pairs that begin at these places (``NO_RANK`` if none), and their places in the table."""
        after = np.minimum(where + 1, max(0, len(sym) - 1))
        key = sym[where] << 32 | sym[after]
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (seq[where] == seq[after]) & (after > where), self.rank[at], NO_RANK), at

    def count(self, sequences: list[bytes]) -> np.ndarray:
        """Symbols that survive in each sequence."""
        return self.merge(sequences)[1]

    def merge(self, sequences: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The surviving symbols of all sequences, one after another, and how many each has."""
        size = np.array([len(s) for s in sequences], np.int64)
        count = np.zeros(len(sequences), np.int64)
        alive = np.flatnonzero(size)
        size = size[alive]
        raw = np.frombuffer(b"".join(sequences), np.uint8)
        sym = self.base[raw]
        if len(alive):
            end = np.cumsum(size) - 1
            sym[end] = self.last[raw[end]]
        done = []
        seq = np.repeat(np.arange(len(alive)), size)
        rank, at = self._pairs(sym, seq, np.arange(len(sym)))
        while len(alive):
            start = np.cumsum(size) - size
            low = np.minimum.reduceat(rank, start)
            more = low < NO_RANK
            if not more.all():
                stays = more[seq]
                count[alive[~more]] = size[~more]
                done.append((alive[~more], sym[~stays], size[~more]))
                alive, size, low = alive[more], size[more], low[more]
                sym, rank, at = sym[stays], rank[stays], at[stays]
                seq = np.repeat(np.arange(len(alive)), size)
            hit = np.flatnonzero(rank == low[seq])
            if not len(hit):
                continue
            # in a run of equal symbols the pairs overlap; every second one merges, from the left
            n = np.arange(len(hit))
            first = np.maximum.accumulate(np.where(np.diff(hit, prepend=-2) != 1, n, 0))
            hit = hit[(n - first) % 2 == 0]
            sym[hit] = self.made[at[hit]]
            stays = np.ones(len(sym), bool)
            stays[hit + 1] = False
            size = size - np.bincount(seq[hit], minlength=len(alive))
            sym, seq, rank, at = sym[stays], seq[stays], rank[stays], at[stays]
            # only the pairs on either side of a merged symbol are new
            place = hit - np.arange(len(hit))
            around = np.concatenate([place, place[place > 0] - 1])
            rank[around], at[around] = self._pairs(sym, seq, around)
        out, start = np.zeros(int(count.sum()), np.int32), np.cumsum(count) - count
        for which, symbols, n in done:
            out[np.repeat(start[which] - (np.cumsum(n) - n), n) + np.arange(len(symbols))] = symbols
        return out, count


class TokenCounter:
    """Counts tokens of texts; one per Python worker."""

    def __init__(self, path: str, pattern: str):
        self.merger = RankMerger(path)
        self.words = regex.compile(pattern).findall
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.merger.special, key=len, reverse=True)))) if self.merger.special else None
        self.known: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for lo, hi in slices(texts):
            found, extra = [], []
            for t in texts[lo:hi]:
                if self.cut and self.cut.search(t):
                    parts = self.cut.split(t)
                    found.append([w for p in parts for w in self.words(p)])
                    extra.append(len(parts) - 1)
                else:
                    found.append(self.words(t))
                    extra.append(0)
            if len(self.known) > CACHE_ENTRIES:
                self.known.clear()
            new = list(set().union(*found).difference(self.known))
            if new:
                self.known.update(zip(new, self.merger.count([w.encode() for w in new]).tolist(), strict=True))
            get = self.known.__getitem__
            out += [sum(map(get, ws)) + e for ws, e in zip(found, extra, strict=True)]
        return out


def count_tokens(docs: DataFrame, tokenizer: str, pattern: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` for every whole text.

    ``tokenizer`` names a byte-level BPE file of the tokenizers library that every worker can open and
    ``pattern`` its pre-token pattern. One narrow pass: no shuffle, only the two columns are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(tokenizer, pattern)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = counter.counts(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_or_empty(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
