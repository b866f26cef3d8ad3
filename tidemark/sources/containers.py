"""Durations of video files from their headers: MP4 (``moov/mvhd``) and AVI (``RIFF/hdrl/avih``).

Spark lists the files and deals them to tasks; a task walks a file's boxes or chunks by ranged reads of their heads and
skips their bodies. Files that can't be read or hold no duration are rows with 0.0 and a reason.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Boxes or chunks that are looked at before a file is given up.
MOST_BOXES = 10_000
Read = Callable[[int, int], bytes]


class Unreadable(ValueError):
    """A file without a duration that can be read."""


def mp4_duration(read: Read, size: int) -> float:
    at, end, seen = 0, size, 0
    while at + 8 <= end:
        head = read(at, 16)
        n, kind, long_n = int.from_bytes(head[:4], "big"), head[4:8], int.from_bytes(head[8:16], "big")
        skip = 16 if n == 1 else 8
        n = long_n if n == 1 else end - at if n == 0 else n
        seen += 1
        if n < skip or seen > MOST_BOXES:
            raise Unreadable("a box without a size")
        if kind == b"moov":
            at, end = at + skip, min(end, at + n)
        elif kind == b"mvhd":
            body = read(at + skip, 32)
            scale, units = struct.unpack(">IQ", body[20:32]) if body[:1] == b"\x01" else struct.unpack(">II", body[12:20])
            if scale == 0:
                raise Unreadable("no time scale")
            return units / scale
        else:
            at += n
    raise Unreadable("no movie header")


def avi_duration(read: Read, size: int) -> float:
    at, end, seen = 12, size, 0
    while at + 8 <= end:
        head = read(at, 12)
        kind, n, inner = head[:4], int.from_bytes(head[4:8], "little"), head[8:12]
        seen += 1
        if seen > MOST_BOXES:
            raise Unreadable("too many chunks")
        if kind == b"LIST" and inner == b"hdrl":
            at, end = at + 12, min(end, at + 8 + n)
        elif kind == b"avih":
            step, _, _, _, frames = struct.unpack("<5I", read(at + 8, 20))
            return step * frames / 1_000_000
        else:
            at += 8 + n + n % 2
    raise Unreadable("no main header")


def duration(read: Read, size: int) -> float:
    """``read(at, n)`` gives bytes of the file, fewer at its end."""
    head = read(0, 12)
    if head[:4] == b"RIFF" and head[8:12] == b"AVI ":
        return avi_duration(read, size)
    if len(head) >= 8 and head[4:8] in (b"ftyp", b"moov", b"mdat", b"free", b"wide", b"skip"):
        return mp4_duration(read, size)
    raise Unreadable("neither MP4 nor AVI")


def durations(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``probed`` of every file below a folder. Spark lists no empty files."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return probed(listed.select("path"))


def probed(paths: DataFrame) -> DataFrame:
    """``path, duration, bytes_read, error`` of the files named in ``path``; files that aren't there have 0.0 too."""

    def probe(path: str | None) -> tuple[float, int, str | None]:
        seen = 0
        try:
            if path is None:
                raise Unreadable("no path")
            fs, name = pafs.FileSystem.from_uri(path)
            with fs.open_input_file(name) as f:
                size = f.size()

                def read(at: int, n: int) -> bytes:
                    nonlocal seen
                    data = f.read_at(max(0, min(n, size - at)), at)
                    seen += len(data)
                    return data

                return duration(read, size), seen, None
        except (Unreadable, struct.error, OSError, pa.ArrowException) as e:
            return 0.0, seen, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [probe(p) for p in b.column(0).to_pylist()]
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.float64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["path", "duration", "bytes_read", "error"])

    return paths.select("path").mapInArrow(run, "path string, duration double, bytes_read long, error string")


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + kind + body


def chunk(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return kind + struct.pack("<I", len(body)) + body + bytes(len(body) % 2)


def mp4_head(units: int, scale: int, movie: bytes = b"", version: int = 0) -> bytes:
    """A file of this duration whose media data come first; for listings and tests."""
    times = struct.pack(">QQIQ", 0, 0, scale, units) if version else struct.pack(">IIII", 0, 0, scale, units)
    return box(b"ftyp", b"isom") + box(b"mdat", movie) + box(b"moov", box(b"udta", b"x"), box(b"mvhd", bytes([version, 0, 0, 0]), times, bytes(80)))


def avi_head(step: int, frames: int, movie: bytes = b"") -> bytes:
    header = chunk(b"avih", struct.pack("<14I", step, 0, 0, 0, frames, *[0] * 9))
    body = b"AVI " + chunk(b"JUNK", b"abc") + chunk(b"LIST", b"hdrl", header) + chunk(b"LIST", b"movi", movie)
    return b"RIFF" + struct.pack("<I", len(body)) + body
