"""AVI motion-JPEG media columns: write, index, decode intra frames, detect shots.

Writing. A payload is stored as baseline JPEG frames whose quantised coefficients carry it: 64 bytes are
one 8x8 block, the byte v being the coefficient (in the DC's case its difference, predicted from 0 at each
restart) of size category 8 with the extra bits v, that is v for v >= 128 and v - 255 otherwise. The frame's
Huffman tables hold the one symbol "no zeros before, 8 bits" as the code 0, so a block takes 576 bits, and
a restart marker follows every block but the last. Any JPEG decoder that gives coefficients gets the
payload back; quantisation steps are 1.

Reading. The RIFF chunks are walked to ``hdrl``, ``movi`` and ``idx1``; frames are fetched through the index.
Frames of the shape above decode as arrays; other baseline frames of one component decode code by code.
Pixels come from an inverse DCT in whole numbers, alike on every machine.

Shots. Histograms of neighbouring frames are compared; a frame starts a shot if its difference exceeds
the mean of the ``reach`` differences on either side by ``factor`` and also ``least``. Shots are clips with times.

Cases: a null or empty text is one block of zeros; every payload is a multiple of 64 bytes; the last frame
is filled with zero blocks, and a ``plen`` chunk holds the payload's length; repeated rows give repeated
results; null doc_ids pass through; other columns aren't read; an empty table gives an empty result. RIFF
sizes have 32 bits: a payload of over 3 GB raises ValueError (a Spark string ends at 2 GB).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, text_or_empty

BLOCK = 64
WIDE, HIGH = 8, 4  # blocks of a full frame: 64 x 32 pixels, 2048 bytes
FPS = 25
BINS = 32

# Fixed value: order of coefficients in a JPEG block (ITU-T T.81, figure A.6).
ZIGZAG = [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]


def _basis() -> np.ndarray:
    """Pixels of each coefficient in zigzag order, times 2**13, rounded: sums stay exact in float64."""
    x = np.arange(8)
    c = np.where(x == 0, np.sqrt(0.5), 1.0)
    one = 0.5 * c[:, None] * np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16)
    both = np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)
    return np.rint(both[ZIGZAG] * 8192)


BASIS = _basis()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _frame_head(wide: int, high: int) -> bytes:
    one_code = bytes([1] + [0] * 15)
    return b"".join([
        b"\xff\xd8",
        _segment(0xDB, b"\0" + b"\1" * 64),
        _segment(0xC0, struct.pack(">BHHB", 8, 8 * high, 8 * wide, 1) + b"\1\x11\0"),
        _segment(0xC4, b"\0" + one_code + b"\x08"),
        _segment(0xC4, b"\x10" + one_code + b"\x08"),
        _segment(0xDD, b"\0\1"),
        _segment(0xDA, b"\1\1\0\0\x3f\0"),
    ])


def encode_frames(payload: bytes) -> tuple[list[bytes], int, int]:
    """JPEG frames of a payload (a multiple of 64 bytes), and their size in blocks."""
    blocks = len(payload) // BLOCK
    wide, high = (WIDE, HIGH) if blocks >= WIDE * HIGH else (min(blocks, WIDE), -(-blocks // WIDE))
    per = wide * high
    frames = -(-blocks // per)
    raw = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    head, out = _frame_head(wide, high), []
    for lo in range(0, frames, 256):  # a part of the frames at a time
        units = raw[lo * per : (lo + 256) * per]
        units = np.concatenate([units, np.zeros((-len(units) % per, BLOCK), np.uint8)])
        bits = np.zeros((len(units), BLOCK, 9), np.uint8)  # the code 0, then the 8 extra bits
        bits[:, :, 1:] = np.unpackbits(units.reshape(-1, 1), axis=1).reshape(-1, BLOCK, 8)
        packed = np.packbits(bits.reshape(len(units), -1), axis=1)
        for f in range(0, len(units), per):
            scan = [packed[f + k].tobytes().replace(b"\xff", b"\xff\0") for k in range(per)]
            marks = [bytes([0xFF, 0xD0 + k % 8]) for k in range(per - 1)]
            out.append(head + b"".join(x for pair in zip(scan, [*marks, b""], strict=True) for x in pair) + b"\xff\xd9")
    return out, wide, high


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(payload: bytes, fps: int = FPS) -> bytes:
    """An AVI file with the payload in its frames."""
    if not payload or len(payload) % BLOCK or len(payload) > 3 << 30:
        raise ValueError("a payload is a positive multiple of 64 bytes, of 3 GB at most")
    frames, wide, high = encode_frames(payload)
    largest = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, 8 * wide, 8 * high, 0, 0, 0, 0)
    strh = b"vids" + b"MJPG" + struct.pack("<IHHIIIIIIiI4H", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, -1, 0, 0, 0, 8 * wide, 8 * high)
    strf = struct.pack("<IiiHH4sIiiII", 40, 8 * wide, 8 * high, 1, 8, b"MJPG", 64 * wide * high, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    at, index, body = 4, [], []
    for f in frames:
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        body.append(_chunk(b"00dc", f))
        at += len(body[-1])
    rest = b"AVI " + head + _chunk(b"plen", struct.pack("<Q", len(payload))) + _chunk(b"LIST", b"movi" + b"".join(body)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", rest)


def read_index(data: bytes) -> dict:
    """``fps``, ``payload`` (bytes, or None) and ``frames``: (start, end) of every frame, from idx1."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out, entries, movi, spans = {"fps": float(FPS), "payload": None}, b"", 0, [(12, len(data))]
    while spans:
        at, end = spans.pop()
        while at + 8 <= end:
            name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
                movi = at + 8
            elif name == b"LIST":
                spans.append((at + 12, at + 8 + size))
            elif name == b"strh":
                scale, rate = struct.unpack("<II", data[at + 28 : at + 36])
                out["fps"] = rate / max(1, scale)
            elif name == b"plen":
                out["payload"] = int.from_bytes(data[at + 8 : at + 16], "little")
            elif name == b"idx1":
                entries = data[at + 8 : at + 8 + size]
            at += 8 + size + (size & 1)
    table = np.frombuffer(entries, np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]))
    table = table[table["id"] == b"00dc"]
    # offsets count from 'movi' in most files, from the file's start in others
    shift = movi if len(table) and data[movi + int(table["at"][0]) :][:4] == b"00dc" else 0
    start = table["at"].astype(np.int64) + shift + 8
    return out | {"frames": list(zip(start.tolist(), (start + table["size"]).tolist(), strict=True))}


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    out, code, k = {}, 0, 0
    for size, n in enumerate(counts, 1):
        for _ in range(n):
            out[size, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def decode_frame(jpeg: bytes) -> tuple[np.ndarray, int, int]:
    """Quantised coefficients (blocks, 64) in zigzag order with the DC restored, times the quantisation
    steps; and the frame's width and height in blocks. Baseline frames of one component."""
    at, tables, steps, restart, shape = 2, {}, np.ones(64, np.int64), 0, None
    while True:
        marker, size = jpeg[at + 1], int.from_bytes(jpeg[at + 2 : at + 4], "big")
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            steps = np.frombuffer(body[1:65], np.uint8).astype(np.int64)
        elif marker == 0xC0:
            high, wide = struct.unpack(">HH", body[1:5])
            if body[0] != 8 or body[5] != 1:
                raise ValueError("only 8-bit frames of one component")
            shape = -(-wide // 8), -(-high // 8)
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = body[1:17], body[17 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            break
        elif 0xC1 <= marker <= 0xCF:
            raise ValueError("only baseline frames")
    wide, high = shape
    scan = jpeg[at : jpeg.rindex(b"\xff\xd9")]
    fixed = (bytes([1] + [0] * 15), b"\x08")
    coefficients = _fixed_scan(scan, wide * high) if restart == 1 and tables.get(0) == tables.get(0x10) == fixed else _coded_scan(scan, wide * high, tables, restart)
    return coefficients * steps, wide, high


def _fixed_scan(scan: bytes, blocks: int) -> np.ndarray:
    # a marker's FF is followed by D0-D7, a stuffed one by 00
    raw = np.frombuffer(scan, np.uint8)
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    drop = np.zeros(len(raw), bool)
    drop[ff + 1] = True
    marks = ff[raw[ff + 1] != 0]
    drop[marks] = True
    units = np.unpackbits(raw[~drop]).reshape(blocks, BLOCK, 9)
    if units[:, :, 0].any():
        raise ValueError("a code that no table has")
    v = np.packbits(units[:, :, 1:], axis=2).reshape(blocks, BLOCK).astype(np.int64)
    return np.where(v >= 128, v, v - 255)


def _coded_scan(scan: bytes, blocks: int, tables: dict, restart: int) -> np.ndarray:
    dc, ac = _codes(*tables[0]), _codes(*tables[0x10])
    out = np.zeros((blocks, 64), np.int64)
    parts, lo = [], 0
    for k in range(len(scan) - 1):
        if scan[k] == 0xFF and 0xD0 <= scan[k + 1] <= 0xD7:
            parts.append(scan[lo:k])
            lo = k + 2
    parts.append(scan[lo:])
    bits, at = "", 0

    def symbol(codes):
        nonlocal at
        for size in range(1, 17):
            if (size, code := int(bits[at : at + size], 2)) in codes:
                at += size
                return codes[size, code]
        raise ValueError("a code that no table has")

    def value(size):
        nonlocal at
        v = int(bits[at : at + size], 2) if size else 0
        at += size
        return v if not size or v >> (size - 1) else v - (1 << size) + 1

    for b in range(blocks):
        if b == 0 or restart and b % restart == 0:
            data = parts.pop(0).replace(b"\xff\0", b"\xff")
            bits, at, before = "".join(f"{x:08b}" for x in data) + "1" * 16, 0, 0
        before += value(symbol(dc))
        out[b, 0], k = before, 1
        while k < 64:
            s = symbol(ac)
            if s == 0:
                break
            k += s >> 4
            if s & 15:
                out[b, k] = value(s & 15)
            k += 1
    return out


def payload_of(coefficients: np.ndarray) -> np.ndarray:
    """The bytes that ``encode_frames`` put into coefficients."""
    if (coefficients == 0).any() or (np.abs(coefficients) < 128).any() or (np.abs(coefficients) > 255).any():
        raise ValueError("these frames carry no payload")
    return np.where(coefficients >= 0, coefficients, coefficients + 255).astype(np.uint8).reshape(-1)


def pixels(coefficients: np.ndarray) -> np.ndarray:
    """8-bit samples (blocks, 64)."""
    return np.clip(np.floor((coefficients.astype(np.float64) @ BASIS + 4096) / 8192) + 128, 0, 255).astype(np.uint8)


def histograms(samples: np.ndarray, frames: int) -> np.ndarray:
    bins = (samples.reshape(frames, -1) // (256 // BINS)).astype(np.int64)
    return np.bincount((np.arange(frames)[:, None] * BINS + bins).ravel(), minlength=frames * BINS).reshape(frames, BINS)


def shots(hist: np.ndarray, reach: int = 4, factor: float = 1.5, least: float = 0.25) -> list[tuple[int, int]]:
    """(first, end) frames of every shot, by an adaptive threshold on histogram differences."""
    n = len(hist)
    if n < 2:
        return [(0, n)] if n else []
    d = np.abs(np.diff(hist, axis=0)).sum(axis=1)
    total = np.concatenate([[0], np.cumsum(d)])
    k = np.arange(n - 1)
    lo, hi = np.maximum(k - reach, 0), np.minimum(k + reach + 1, n - 1)
    others = np.maximum(hi - lo - 1, 1)
    around = total[hi] - total[lo] - d
    cuts = np.flatnonzero((d * others > factor * around) & (d > least * hist[0].sum())) + 1
    edges = [0, *cuts.tolist(), n]
    return list(zip(edges[:-1], edges[1:], strict=True))


def read_media(data: bytes) -> dict:
    """Payload, fps, histograms' shots of one AVI file written by ``write_avi``."""
    index = read_index(data)
    payload, hist = [], [np.zeros((0, BINS), np.int64)]
    for lo in range(0, len(index["frames"]), 256):
        part = [decode_frame(data[a:b])[0] for a, b in index["frames"][lo : lo + 256]]
        coefficients = np.concatenate(part)
        payload.append(payload_of(coefficients).tobytes())
        hist.append(histograms(pixels(coefficients), len(part)))
    return {"payload": b"".join(payload)[: index["payload"]], "fps": index["fps"], "frames": len(index["frames"]), "shots": shots(np.concatenate(hist))}


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fps: int = FPS) -> DataFrame:
    """``id_col, n_bytes, media``: every whole text as an AVI file in a binary column."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in slices(texts, 1 << 22):
                raw = [t.encode() for t in texts[lo:hi]]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([len(r) for r in raw], pa.int64()), pa.array([write_avi(r + b"\0" * (-len(r) % BLOCK or BLOCK * (not r)), fps) for r in raw], pa.binary())], names=[id_col, "n_bytes", "media"])

    return docs.select(id_col, text_or_empty(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def clips(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row per shot: ``id_col, clip, first_frame, end_frame, start_sec, end_sec``; none for null media."""
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, *s, s[0] / m["fps"], s[1] / m["fps"]) for i, data in zip(b.column(0).to_pylist(), b.column(1), strict=True) if data.is_valid for m in [read_media(data.as_py())] for k, s in enumerate(m["shots"])]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], b.column(0).type), *(pa.array(c, pa.int64()) for c in columns[1:4]), *(pa.array(c, pa.float64()) for c in columns[4:])], names=[id_col, "clip", "first_frame", "end_frame", "start_sec", "end_sec"])

    return media.select(id_col, media_col).mapInArrow(run, f"`{id_col}` {kind}, clip long, first_frame long, end_frame long, start_sec double, end_sec double")


def features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """``id_col, n_bytes``, digests of the stored file and of the payload read back, and ``feature``:
    frames, frame rate and the first frames of its shots (``12@25:0,5``)."""
    kind = media.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data in b.column(2):
                file = data.as_py()
                m = read_media(file)
                p = m["payload"]
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(file), hashlib.sha256(file).hexdigest(), f"{m['frames']}@{m['fps']:g}:{','.join(str(s) for s, _ in m['shots'])}"))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True))], names=names)

    return media.select(id_col, "n_bytes", media_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
