"""WARC archives, index first: written with an index row per record, read back by coalesced byte ranges.

``plan_records`` decides which pages are responses and which revisit an equal payload; ``write`` puts each
task's pages into an archive of its own (one gzip member per record) and returns a row per record with
file, offset, length, URL and digest; ``read`` takes any selection of index rows, sorts it by file and
offset, reads neighbouring records with one request each and parses them.

Archives lie in the shared folder. A file name carries a random part, so a task that runs again writes a
new file; only the rows of the attempt that succeeded reach the index, and bytes of other attempts are
never read. The index is written as a table before anything reads it, so no later recomputation writes
archives anew.

Cases: null html is an empty payload, and empty payloads equal one another; null urls become empty target
URIs; null page ids are written as ``none`` and read as null (a group without any id has no response but
is written as responses); of repeated rows with the largest page id every one is a response; other columns
are dropped; an empty table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import dealt_join
from .common import fresh_path, materialize

INDEX = "file string, offset long, length long, url string, digest string, page_id {id}, record_type string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plan_records(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, html, keeper``: the page whose response each page revisits, null for responses.

    Only digests are grouped (with partial sums in each task), and only digests of two or more pages are
    joined back. They are written as a table first, so Spark knows its size: a small one is broadcast and no page
    is shuffled. Pages of a payload that very many share are dealt over several keys (``dealt_join``).
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).withColumn("__sha", F.sha1(F.col("html").cast("binary")))
    groups = rows.where(F.octet_length("html") >= least_bytes).groupBy("__sha").agg(F.max("page_id").alias("__keeper"), F.count("*").alias("__n")).where("__n > 1")
    groups, _ = materialize(groups, "warc-keepers")
    same = F.col("page_id").eqNullSafe(F.col("__keeper"))
    met = dealt_join(rows, groups, "__sha", ["page_id", "url"], "__n", pages.count(), "left")
    return met.select("page_id", "url", "html", F.when(~same, F.col("__keeper")).alias("keeper"))


def _name(page_id) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def record(page_id, url: str | None, payload: bytes, keeper, date: str) -> tuple[bytes, str]:
    """One WARC/1.1 record as a gzip member, and its payload digest."""
    sha = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if keeper is not None else http + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if keeper is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Target-URI: {target}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{sha}"]
    if keeper is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(keeper)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    gz = zlib.compressobj(4, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + gz.flush(), sha


def parse(member: bytes) -> dict:
    """Headers, block and payload of one record."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record here")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [x.split(b":", 1)[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    return {"headers": headers, "payload": payload, "http_length": int(sizes[0]) if sizes else None}


def write(planned: DataFrame, directory: str | None = None, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes the pages of ``plan_records`` as archives and returns the index, itself a written table."""
    spark = planned.sparkSession
    directory = directory or fresh_path(spark, "warc")
    kind = planned.schema["page_id"].dataType.simpleString()
    id_type = pa.from_numpy_dtype("int64") if kind in ("bigint", "long") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(directory)
        sink, at, path = None, 0, f"part-{uuid.uuid4().hex}.warc.gz"
        try:
            for b in batches:
                rows = []
                for page, url, html, keeper in zip(*(c for c in b.columns), strict=True):
                    if sink is None:
                        fs.create_dir(root, recursive=True)
                        sink = fs.open_output_stream(f"{root}/{path}", compression=None)
                    page, url, keeper = page.as_py(), url.as_py(), keeper.as_py()
                    data, sha = record(page, url, html.as_py().encode(), keeper, date)
                    sink.write(data)
                    rows.append((f"{directory}/{path}", at, len(data), url, sha, page, "response" if keeper is None else "revisit"))
                    at += len(data)
                columns = list(zip(*rows, strict=True)) or [[]] * 7
                types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), id_type or b.column(0).type, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["file", "offset", "length", "url", "digest", "page_id", "record_type"])
        finally:
            if sink is not None:
                sink.close()

    index = planned.select("page_id", "url", "html", "keeper").mapInArrow(run, INDEX.format(id=kind))
    return materialize(index, "warc-index")[0]


def ranges(rows: list[tuple[int, int]], gap: int, most: int) -> list[tuple[int, int, int]]:
    """Sorted (offset, length) rows as reads: (first row, offset, length). Rows up to ``gap`` bytes apart
    share a read of up to ``most`` bytes (a longer record has a read of its own)."""
    out: list[list[int]] = []
    for k, (at, n) in enumerate(rows):
        if out and at - (out[-1][1] + out[-1][2]) <= gap and at + n - out[-1][1] <= most:
            out[-1][2] = max(out[-1][2], at + n - out[-1][1])
        else:
            out.append([k, at, n])
    return [tuple(x) for x in out]


def read(index: DataFrame, gap: int = 1 << 16, most: int = 8 << 20, stretch: int = 16 << 20, payloads: bool = True) -> DataFrame:
    """The records of the index rows given, which may be a selection: ``page_id, url, payload_bytes,
    payload_digest, record_type, refers_to`` and the ``payload`` (null for revisits; left out if not asked for).

    Rows are dealt by file and stretch of the file to as many tasks as the selected bytes have stretches, sorted by
    offset within their task. A response whose
    payload doesn't give its digest raises ValueError.
    """
    kind = index.schema["page_id"].dataType.simpleString()
    to_id = int if kind in ("bigint", "int", "long", "smallint", "tinyint") else str
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads

    def records(part: list[tuple[str, int, int]]) -> Iterator[dict]:
        by_file: dict[str, list[tuple[int, int]]] = {}
        for f, at, n in part:
            by_file.setdefault(f, []).append((at, n))
        for f, rows in by_file.items():
            fs, path = pafs.FileSystem.from_uri(f)
            with fs.open_input_file(path) as source:
                reads = ranges(rows, gap, most)
                for (k, at, n), after in zip(reads, [*(r[0] for r in reads[1:]), len(rows)], strict=True):
                    data = source.read_at(n, at)
                    for o, size in rows[k:after]:
                        yield parse(data[o - at : o - at + size])

    def from_name(x: str | None):
        text = x[len("<urn:x-page:") : -1] if x else "none"
        return None if text == "none" else to_id(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in records(list(zip(*(c.to_pylist() for c in b.columns), strict=True))):
                h, revisit = r["headers"], r["headers"]["WARC-Type"] == "revisit"
                sha = h["WARC-Payload-Digest"].removeprefix("sha1:")
                if not revisit and digest(r["payload"]) != sha:
                    raise ValueError(f"payload of {h['WARC-Record-ID']} doesn't give its digest")
                rows.append((from_name(h["WARC-Record-ID"]), h["WARC-Target-URI"], r["http_length"] if revisit else len(r["payload"]), sha, h["WARC-Type"], from_name(h.get("WARC-Refers-To")), *[None if revisit else r["payload"]] * payloads))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            own = pa.int64() if to_id is int else pa.string()
            types = [own, pa.string(), pa.int64(), pa.string(), pa.string(), own, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types[: len(names)], strict=True)], names=names)

    out_id = "long" if to_id is int else "string"
    dealt = index.select("file", "offset", "length").withColumn("__stretch", F.floor(F.col("offset") / stretch))
    size = index.agg(F.sum("length")).first()[0] or 0  # a number of tasks of its own: AQE would go by the index's bytes
    dealt = dealt.repartition(max(1, -(-size // stretch)), "file", "__stretch").sortWithinPartitions("file", "offset").drop("__stretch")
    return dealt.mapInArrow(run, f"page_id {out_id}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {out_id}" + ", payload binary" * payloads)
