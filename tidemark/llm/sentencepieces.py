"""SentencePiece encoding that keeps the place of every piece in the original bytes, and decoding.

Normalisation walks a text by longest prefix through the model's compiled character map (a double-array
trie over UTF-8 bytes followed by the replacement strings) and records, for each normalised byte, the
original byte it came from. Pieces cover the normalised bytes without gaps, so their lengths add up to
positions there and the record projects every piece to its span of original bytes.

Ids come from those normalised bytes: they go to a processor of the same pieces whose own normalisation is
switched off. Where no piece but those made of spaces alone holds a space after its first character, a normalised
text falls apart at the borders before spaces into stretches that encode independently, and a bounded cache of
stretches saves most of the library's work. Models that break this rule are encoded as whole texts.

Cases: null and empty texts have no ids and decode to the empty text; repeated rows give repeated
results; no other column than the two named is read; null doc_ids pass through; very long texts are
encoded whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from .common import CACHE_ENTRIES, slices, text_or_empty

SPACE = "▁"
#: A stretch starts at the first space of a run of spaces and ends before the next run; the sign that
#: stands for a space is one.
STRETCH = re.compile(f"[ {SPACE}]*[^ {SPACE}]+|[ {SPACE}]+")
BYTE_PIECE = re.compile(r"<0x[0-9A-F]{2}>\Z")


class CharacterMap:
    """The compiled map of a model: ``longest(data, at)`` gives (bytes read, replacement) or None."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        units, best = self.units, None
        if not units:
            return None
        node = 0
        offset = lambda u: (u >> 10) << ((u & 512) >> 6)
        node = offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            u = units[node]
            if u & 0x800000FF != data[i]:
                break
            node ^= offset(u)
            if u >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                best = (i + 1 - at, self.strings[value : self.strings.index(b"\0", value)])
        return best


class OffsetEncoder:
    """One per Python worker; ``normalize`` gives normalised bytes and their places, ``encode`` ids, ``spans`` their
    original byte spans."""

    def __init__(self, model: str):
        with open(model, "rb") as f:
            spec = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        self.library = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        norm = spec.normalizer_spec
        self.map = CharacterMap(norm.precompiled_charsmap)
        self.prefix, self.squeeze = norm.add_dummy_prefix, norm.remove_extra_whitespaces
        self.suffix = spec.trainer_spec.treat_whitespace_as_suffix
        self.space = (SPACE if norm.escape_whitespaces else " ").encode()
        pieces = [p.piece for p in spec.pieces]
        self.width = np.array([1 if BYTE_PIECE.match(p) else len(p.encode()) for p in pieces], np.int64)
        self.unknown = spec.trainer_spec.unk_id
        self.own = sorted((p.piece.encode() for p in spec.pieces if p.type == p.USER_DEFINED), key=len, reverse=True)
        inner = any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.stretches = not (inner or self.own or self.suffix) and norm.escape_whitespaces and spec.trainer_spec.byte_fallback
        self.plain = not (self.map.units or self.squeeze or self.own or self.suffix)
        # the same pieces without any normalisation: what it encodes are our bytes
        norm.precompiled_charsmap, norm.name = b"", "identity"
        norm.add_dummy_prefix = norm.remove_extra_whitespaces = norm.escape_whitespaces = False
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        self.known: dict[str, bytes] = {}

    def _step(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Bytes read at a place and what they become: an own symbol as it is, else by the longest prefix in the map."""
        for symbol in self.own:
            if data.startswith(symbol, at):
                return len(symbol), symbol
        if found := self.map.longest(data, at):
            return found
        n = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
        return n, data[at : at + n]

    def normalize(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them (and the end) the original byte it stands at."""
        data = text.encode()
        if self.plain:
            if not data:
                return b"", np.zeros(1, np.int64)
            raw = np.frombuffer(data, np.uint8)
            wide = np.where(raw == 32, len(self.space), 1)
            place = np.append(np.repeat(np.arange(len(raw)), wide), len(raw))
            lead = self.space if self.prefix else b""
            return lead + data.replace(b" ", self.space), np.concatenate([np.zeros(len(lead), np.int64), place])
        out, place, at = bytearray(), [], 0
        if self.squeeze:
            while at < len(data) and (step := self._step(data, at))[1] == b" ":
                at += step[0]
        if at == len(data):
            return b"", np.zeros(1, np.int64)
        if self.prefix and not self.suffix:
            out += self.space
            place += [at] * len(self.space)
        spaced = self.squeeze
        while at < len(data):
            n, made = self._step(data, at)
            if spaced:
                made = made.lstrip(b" ")
            if made:
                spaced = made.endswith(b" ")
                made = made.replace(b" ", self.space)
                out += made
                place += [at] * len(made)
            at += n
            spaced = spaced and self.squeeze
        if self.squeeze:
            while out.endswith(self.space):
                del out[-len(self.space) :]
                at = place[-len(self.space)]
                del place[-len(self.space) :]
        if self.prefix and self.suffix:
            out += self.space
            place += [at] * len(self.space)
        return bytes(out), np.array([*place, at], np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.encode_normalized([self.normalize(t)[0] for t in texts])

    def encode_normalized(self, normalized: list[bytes]) -> list[np.ndarray]:
        """The ids of normalised texts."""
        texts = [n.decode() for n in normalized]
        if not self.stretches:
            return [np.array(x, np.int32) for x in self.pieces.encode(texts, num_threads=1)]
        out = []
        for lo, hi in slices(texts):
            parts = [STRETCH.findall(t) for t in texts[lo:hi]]
            if len(self.known) > CACHE_ENTRIES:
                self.known.clear()
            new = list(set().union(*parts).difference(self.known))
            self.known.update((w, np.array(ids, np.int32).tobytes()) for w, ids in zip(new, self.pieces.encode(new, num_threads=1), strict=True))
            get = self.known.__getitem__
            out += [np.frombuffer(b"".join(map(get, p)), np.int32) for p in parts]
        return out

    def spans(self, norm: bytes, place: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Start and end in the original UTF-8 bytes of every piece of a normalised text, shape (n, 2)."""
        width = self.width[ids]
        if not self.stretches and (ids == self.unknown).any():
            # an unknown piece covers what the pieces around it leave
            width = self._with_unknown(norm, ids)
        end = np.cumsum(width)
        if len(ids) and end[-1] != len(norm):
            raise ValueError("pieces don't cover the normalised text")
        # a piece of the dummy prefix alone is empty; bytes of one replaced character span all of it or nothing
        return np.stack([place[end - width], place[end]], axis=1) if len(ids) else np.zeros((0, 2), np.int64)

    def _with_unknown(self, norm: bytes, ids: np.ndarray) -> np.ndarray:
        names = [self.library.id_to_piece(int(i)).encode() for i in ids]
        width, at = [], 0
        for k, (i, name) in enumerate(zip(ids, names, strict=True)):
            if i != self.unknown:
                width.append(len(name))
            else:
                after = next((m for j, m in zip(ids[k + 1 :], names[k + 1 :], strict=True) if j != self.unknown), None)
                width.append((norm.index(after, at + 1) if after is not None else len(norm)) - at)
            at += width[-1]
        return np.array(width, np.int64)

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.library.decode([x.tolist() for x in ids], num_threads=1) if ids else []


def encode(docs: DataFrame, model: str, outputs: tuple[str, ...] = ("ids", "starts", "ends", "decoded"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``outputs``: any of ``ids``, ``starts``, ``ends`` (spans in original UTF-8 bytes),
    ``decoded``, and the digests ``n_tokens``, ``spanned_bytes`` (original bytes that the spans cover),
    ``spans_crc32`` (of all starts and ends as little-endian 64-bit numbers), ``ids_sha256``, ``decoded_sha256``, which spare sending arrays out of the worker. One narrow pass.
    """
    types = {"ids": (pa.list_(pa.int32()), "array<int>"), "starts": (pa.list_(pa.int64()), "array<long>"), "ends": (pa.list_(pa.int64()), "array<long>"), "decoded": (pa.string(), "string"), "n_tokens": (pa.int64(), "long"), "spanned_bytes": (pa.int64(), "long"), "spans_crc32": (pa.int64(), "long"), "ids_sha256": (pa.string(), "string"), "decoded_sha256": (pa.string(), "string")}
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = OffsetEncoder(model)
        written = [str(i) for i in range(coder.library.get_piece_size())]
        for b in batches:
            all_texts = b.column(1).to_pylist()
            for lo, hi in slices(all_texts, 1 << 21):
                texts = all_texts[lo:hi]
                normal = [coder.normalize(t) for t in texts]
                ids = coder.encode_normalized([n for n, _ in normal])
                spans = [coder.spans(*n, x) for n, x in zip(normal, ids, strict=True)] if {"starts", "ends", "spanned_bytes", "spans_crc32"} & {*outputs} else []
                decoded = coder.decode(ids) if {"decoded", "decoded_sha256"} & {*outputs} else []
                makers = {
                    "ids": lambda: ids,
                    "starts": lambda: [s[:, 0] for s in spans],
                    "ends": lambda: [s[:, 1] for s in spans],
                    "decoded": lambda: decoded,
                    "n_tokens": lambda: [len(x) for x in ids],
                    "spanned_bytes": lambda: [int(s[-1, 1] - s[0, 0]) if len(s) else 0 for s in spans],
                    "spans_crc32": lambda: [zlib.crc32(s.astype("<i8").tobytes()) for s in spans],
                    "ids_sha256": lambda: [hashlib.sha256(",".join([written[i] for i in x.tolist()]).encode()).hexdigest() for x in ids],
                    "decoded_sha256": lambda: [hashlib.sha256(d.encode()).hexdigest() for d in decoded],
                }
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *(pa.array(makers[o](), types[o][0]) for o in outputs)], names=[id_col, *outputs])

    return docs.select(id_col, text_or_empty(text_col)).mapInArrow(run, ", ".join([f"`{id_col}` {kind}", *(f"{o} {types[o][1]}" for o in outputs)]))


def decode(encoded: DataFrame, model: str, ids_col: str = "ids", to: str = "text") -> DataFrame:
    """All columns of ``encoded`` and the text ``to`` that its ids decode to (null ids: null)."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    fields = T.StructType([*(f for f in encoded.schema if f.name != to), T.StructField(to, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = sentencepiece.SentencePieceProcessor(model_file=model)
        for b in batches:
            ids = b.column(b.schema.get_field_index(ids_col)).to_pylist()
            made = iter(coder.decode([x for x in ids if x is not None], num_threads=1) if any(x is not None for x in ids) else [])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if x is None else next(made) for x in ids], pa.string())], names=[*b.schema.names, to])

    return encoded.select(*(F.col(f"`{f.name}`") for f in fields if f.name != to)).mapInArrow(run, fields)
