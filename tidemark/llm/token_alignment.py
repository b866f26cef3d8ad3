"""Alignment of two tokenizers on the same texts, and corpus-wide counts of the token pairs it links.

The tokens of a whole Arrow batch (in slices of whole documents, if it holds much text) are laid end to end, so each
document begins at the byte where the one before ends. Ends of A and of B are counted by place once; where both occur is a
cut. Prefix sums over the cuts give every token its group, and differences of prefix sums at the documents' ends give
each document its results.

Tokens of a group are linked, each of A with each of B. Pair counts cover the corpus. Documents aren't exchanged for
them: a block of documents (``block_chars`` of text, whole documents) lists its distinct pairs once, its documents name
them by place, and only the lists meet in the corpus-wide sum; the sums return to the block. What a block holds is bounded
by its text and, where a group is long, by the distinct pairs within it.

Cases: a text that is null, empty or not given back by its tokens' bytes has no tokens: zeros and an empty digest. Rows
are documents, repeated ones too; null ids pass through; other columns of the input are not read; an empty table gives
an empty result; a long text is aligned whole.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, materialize, slices, text_or_empty
from .sentencepieces import BYTE_PIECE, SPACE, OffsetEncoder
from .token_counts import RankMerger, byte_alphabet

#: Links that are expanded together.
LINKS = 1 << 21
#: A group of more links goes by its distinct ids.
LONG_GROUP = 1 << 14


class ByteLevel:
    """Ids of a byte-level BPE, special strings being ordinary text, and its tokens' bytes."""

    def __init__(self, path: str, pattern: str):
        self.merger = RankMerger(path)
        self.words = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        back = {c: b for b, c in enumerate(byte_alphabet())}
        self.bytes = [b""] * (1 + max(vocab.values()))
        for entry, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in entry) if all(c in back for c in entry) else b""

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        words = [self.words(t) for t in texts]
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        new = list(set().union(*words).difference(self.known))
        if new:
            ids, n = self.merger.merge([w.encode() for w in new])
            end = np.cumsum(n)
            self.known.update((w, ids[e - k : e].tobytes()) for w, e, k in zip(new, end.tolist(), n.tolist(), strict=True))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, ws)), np.int32) for ws in words]


class Pieces:
    """Ids of a SentencePiece model and its pieces' bytes, spaces as they were."""

    def __init__(self, path: str):
        self.coder = OffsetEncoder(path)
        names = [self.coder.library.id_to_piece(i) for i in range(self.coder.library.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if BYTE_PIECE.match(p) else p.replace(SPACE, " ").encode() for p in names]
        self.encode = self.coder.encode


class Alignment:
    """Groups of the tokens of several documents, laid end to end. ``n_a`` and ``n_b`` count each document's tokens."""

    def __init__(self, a: np.ndarray, n_a: np.ndarray, width_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, width_b: np.ndarray):
        self.a, self.b, self.n_a, self.n_b = a, b, n_a, n_b
        end_a, end_b = np.cumsum(width_a[a]), np.cumsum(width_b[b])
        total = int(end_a[-1]) if len(end_a) else 0
        cut = (np.bincount(end_a, minlength=total + 1) & np.bincount(end_b, minlength=total + 1)).astype(bool)
        groups = np.cumsum(cut)  # up to and with each byte
        self.last_a, self.last_b = cut[end_a], cut[end_b]
        self.group_a, self.group_b = groups[end_a] - self.last_a, groups[end_b] - self.last_b
        n = int(groups[-1])
        self.size_a, self.size_b = np.bincount(self.group_a, minlength=n), np.bincount(self.group_b, minlength=n)
        doc_end = np.cumsum(n_a)
        self.through = np.where(doc_end > 0, groups[end_a[np.maximum(doc_end, 1) - 1]], 0) if total else np.zeros(len(n_a), np.int64)
        self.n_groups = np.diff(self.through, prepend=0)
        self.n_links = np.diff(np.append(0, np.cumsum(self.size_a * self.size_b))[self.through], prepend=0)

    def written(self, strings: list[str], n_a_ids: int, n_b_ids: int) -> list[str]:
        """Each document's groups as text. ``strings``: an id of A within and at the end of its group's part, and of B."""
        first_a, first_b = (np.cumsum(s) - s for s in (self.size_a, self.size_b))
        order = np.empty(len(self.a) + len(self.b), np.int64)
        order[np.arange(len(self.a)) + first_b[self.group_a]] = self.a + self.last_a * n_a_ids
        order[np.arange(len(self.b)) + (first_a + self.size_a)[self.group_b]] = 2 * n_a_ids + self.b + self.last_b * n_b_ids
        ends = np.cumsum(self.n_a + self.n_b)
        get = strings.__getitem__
        return ["".join(map(get, order[e - n : e].tolist()))[:-1] for e, n in zip(ends, self.n_a + self.n_b, strict=True)]

    def links(self, n_b_ids: int, n_pairs: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, pair) as document * ``n_pairs`` + A * ``n_b_ids`` + B, sorted, and how often each is linked."""
        doc = np.repeat(np.arange(len(self.n_a)), self.n_a) * n_pairs
        start_b = np.cumsum(self.size_b) - self.size_b
        links = self.size_a * self.size_b
        short = links[self.group_a] <= LONG_GROUP
        rows = np.flatnonzero(short)
        found, times = [], []

        def keep(keys: np.ndarray, n: np.ndarray | None = None) -> None:
            if n is None:
                keys, n = np.unique(keys, return_counts=True)
            found.append(keys)
            times.append(n)

        until = np.cumsum(self.size_b[self.group_a[rows]])
        at = 0
        while at < len(rows):
            stop = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + LINKS)))
            some = rows[at:stop]
            n = self.size_b[self.group_a[some]]
            within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            keep(np.repeat(doc[some] + self.a[some].astype(np.int64) * n_b_ids, n) + self.b[np.repeat(start_b[self.group_a[some]], n) + within])
            at = stop
        start_a = np.cumsum(self.size_a) - self.size_a
        for g in np.flatnonzero(links > LONG_GROUP):
            lo = start_a[g]
            ids_a, times_a = np.unique(self.a[lo : lo + self.size_a[g]], return_counts=True)
            ids_b, times_b = np.unique(self.b[start_b[g] : start_b[g] + self.size_b[g]], return_counts=True)
            step = max(1, LINKS // len(ids_b))
            for k in range(0, len(ids_a), step):
                keys = doc[lo] + ids_a[k : k + step, None].astype(np.int64) * n_b_ids + ids_b
                keep(keys.ravel(), (times_a[k : k + step, None] * times_b).ravel())
        if len(found) == 1:
            return found[0], times[0]
        keys, which = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_inverse=True)
        n = np.zeros(len(keys), np.int64)
        if found:
            np.add.at(n, which, np.concatenate(times))
        return keys, n


DOCUMENT = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def alignments(docs: DataFrame, byte_level: str, pattern: str, pieces: str, block_chars: int = 1 << 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table of aligned documents and, in rows of their own, of their blocks' pairs.

    Documents: ``block, id, n_a, n_b, n_groups, n_links, groups_sha256`` with ``links`` (places in the block's list) and
    ``times``. Blocks: ``block, a, b, n_docs`` (arrays: distinct linked pairs and in how many of the block's documents).
    A encodes a space and the text, B the text, to which it adds the space.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["block", "id", *(c.split()[0] for c in DOCUMENT.split(", ")), "links", "times", "a", "b", "n_docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = ByteLevel(byte_level, pattern), Pieces(pieces)
        n_a_ids, n_b_ids = len(one.bytes), len(two.bytes)
        n_pairs = n_a_ids * n_b_ids
        width_a, width_b = (np.array([len(x) for x in c.bytes], np.int64) for c in (one, two))
        strings = [f"{i}{end}" for n, ends in ((n_a_ids, ",|"), (n_b_ids, ",;")) for end in ends for i in range(n)]
        ints = pa.list_(pa.int32())
        held: list[tuple] = []  # per slice: ids, document columns, keys, times
        chars = 0

        def block() -> Iterator[pa.RecordBatch]:
            number = uuid.uuid4().int >> 65
            pairs = [keys % n_pairs for _, _, keys, _ in held]
            distinct, n_docs = np.unique(np.concatenate(pairs), return_counts=True)
            for (ids, columns, keys, times), pair in zip(held, pairs, strict=True):
                rows = len(ids)
                bounds = np.searchsorted(keys, np.arange(rows + 1) * n_pairs).astype(np.int32)
                lists = [pa.ListArray.from_arrays(bounds, x.astype(np.int32)) for x in (np.searchsorted(distinct, pair), times)]
                yield pa.RecordBatch.from_arrays([pa.array([number] * rows, pa.int64()), ids, *columns, *lists, *[pa.nulls(rows, ints)] * 3], names=names)
            no = [pa.nulls(1, t) for t in (held[0][0].type, *[pa.int64()] * 4, pa.string(), ints, ints)]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *no, *(pa.array([x.astype(np.int32)], ints) for x in (distinct // n_b_ids, distinct % n_b_ids, n_docs))], names=names)
            held.clear()

        for batch in batches:
            all_texts = batch.column(1).to_pylist()
            for lo, hi in slices(all_texts, LINKS):
                texts = all_texts[lo:hi]
                a, b = one.encode([" " + t for t in texts]), two.encode(texts)
                fits = np.zeros(len(texts), bool)
                for k, t in enumerate(texts):
                    data = b" " + t.encode()
                    fits[k] = bool(t) and b"".join(map(one.bytes.__getitem__, a[k].tolist())) == data and b"".join(map(two.bytes.__getitem__, b[k].tolist())) == data
                ids_a, ids_b = ([x if f else x[:0] for x, f in zip(y, fits, strict=True)] for y in (a, b))
                n_a, n_b = (np.array([len(x) for x in y], np.int64) for y in (ids_a, ids_b))
                found = Alignment(np.concatenate(ids_a), n_a, width_a, np.concatenate(ids_b), n_b, width_b)
                groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in found.written(strings, n_a_ids, n_b_ids)]
                columns = [*(pa.array(x, pa.int64()) for x in (n_a, n_b, found.n_groups, found.n_links)), pa.array(groups, pa.string())]
                held.append((batch.column(0).slice(lo, hi - lo), columns, *found.links(n_b_ids, n_pairs)))
                chars += sum(map(len, texts))
                if chars >= block_chars:
                    yield from block()
                    chars = 0
        if held:
            yield from block()

    schema = f"block long, id {kind}, {DOCUMENT}, links array<int>, times array<int>, a array<int>, b array<int>, n_docs array<int>"
    return materialize(docs.select(id_col, text_or_empty(text_col)).mapInArrow(run, schema), "aligned")[0]


def _pairs(aligned: DataFrame) -> DataFrame:
    return aligned.where("a IS NOT NULL").select("block", F.posexplode(F.arrays_zip("a", "b", "n_docs")).alias("place", "p")).select("block", "place", "p.a", "p.b", "p.n_docs")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``a, b, n_docs``: how many documents hold each linked pair of ids. A written table."""
    return materialize(_pairs(aligned).groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs")), "pair-counts")[0]


def scored(aligned: DataFrame, counts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document ``id_col, n_a, n_b, n_groups, n_links, n_best`` (links whose pair has its A id's highest count),
    ``count_sum`` (of its links' pairs) and ``groups_sha256``."""
    kind = aligned.schema["id"].dataType.simpleString()
    best = counts.groupBy("a").agg(F.max("n_docs").alias("most"))  # a row an id of A's vocabulary at most
    judged = counts.join(F.broadcast(best), "a").select("a", "b", F.col("n_docs").alias("count"), (F.col("n_docs") == F.col("most")).alias("best"))
    judged = _pairs(aligned).select("block", "place", "a", "b").join(judged, ["a", "b"]).select(F.col("block").alias("of"), "place", "count", "best")
    docs = aligned.where("links IS NOT NULL").select("block", "id", *(c.split()[0] for c in DOCUMENT.split(", ")), "links", "times")

    def run(held: pa.Table, judged: pa.Table) -> pa.Table:
        place = judged["place"].to_numpy()
        count, top = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], top[place] = judged["count"].to_numpy(), judged["best"].to_numpy().astype(np.int64)
        out = []
        for b in held.to_batches():
            links, times = (b.column(b.schema.get_field_index(c)) for c in ("links", "times"))
            bounds = links.offsets.to_numpy() - links.offsets[0].as_py()
            at, n = links.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            sums = [np.diff(np.append(0, np.cumsum(w[at] * n))[bounds]) for w in (top, count)]
            columns = {c: b.column(b.schema.get_field_index(c)) for c in b.schema.names}
            out.append(pa.RecordBatch.from_arrays([columns["id"], *(columns[c] for c in ("n_a", "n_b", "n_groups", "n_links")), *(pa.array(s, pa.int64()) for s in sums), columns["groups_sha256"]], names=[id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]))
        return pa.Table.from_batches(out)

    return docs.groupBy("block").cogroup(judged.groupBy("of")).applyInArrow(run, f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def align(docs: DataFrame, byte_level: str, pattern: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``scored`` of all documents by their own counts."""
    aligned = alignments(docs, byte_level, pattern, pieces, id_col=id_col, text_col=text_col)
    return scored(aligned, pair_counts(aligned), id_col)
