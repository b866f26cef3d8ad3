"""The event index as a streaming sink: every micro-batch's rows are appended once, whatever is killed in between.

Tasks write part files of their own and report their names; the driver then publishes a batch by one small ledger file that
lists its parts, written aside and renamed. Readers see published parts only. A batch that runs again after a crash finds
its ledger, if it got so far, and drops the parts it has just written; else the parts of the lost attempt are never listed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (pafs.LocalFileSystem(), folder)


class IndexWriter(DataSourceStreamArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        fs, root = _open(self.folder)
        name, rows, sink = f"part-{uuid.uuid4().hex}.parquet", 0, None
        for b in iterator:
            if b.num_rows == 0:
                continue
            if sink is None:
                fs.create_dir(f"{root}/parts", recursive=True)
                sink = pq.ParquetWriter(f"{root}/parts/{name}", b.schema, filesystem=fs)
            sink.write_batch(b)
            rows += b.num_rows
        if sink is not None:
            sink.close()
        return Part(name, rows)

    def commit(self, messages: list[Part | None], batchId: int) -> None:  # noqa: N803
        fs, root = _open(self.folder)
        ledger = f"{root}/batches/{batchId:012d}.json"
        if fs.get_file_info(ledger).type != pafs.FileType.NotFound:
            self.abort(messages, batchId)
            return
        fs.create_dir(f"{root}/batches", recursive=True)
        aside = f"{root}/batches/.{uuid.uuid4().hex}"
        with fs.open_output_stream(aside) as out:
            out.write("".join(json.dumps({"batch": batchId, "part": m.name, "rows": m.rows}) + "\n" for m in messages if m and m.rows).encode())
        fs.move(aside, ledger)

    def abort(self, messages: list[Part | None], batchId: int) -> None:  # noqa: N803
        fs, root = _open(self.folder)
        for m in messages:
            if m and m.rows and fs.get_file_info(f"{root}/parts/{m.name}").type != pafs.FileType.NotFound:
                fs.delete_file(f"{root}/parts/{m.name}")


class EventIndex(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_index"

    def streamWriter(self, schema, overwrite: bool) -> IndexWriter:  # noqa: N802
        return IndexWriter(self.options["path"])


def append(rows: DataFrame, folder: str, checkpoint: str, **trigger):
    """Starts appending a stream to the index in ``folder``, which is one checkpoint's alone; the query is returned."""
    rows.sparkSession.dataSource.register(EventIndex)
    return rows.writeStream.format("event_index").option("path", folder).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def published(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The index's rows and the ``batch`` that brought each; no row where nothing has been published yet."""
    fs, root = _open(folder)
    if fs.get_file_info(f"{root}/batches").type == pafs.FileType.NotFound or fs.get_file_info(f"{root}/parts").type == pafs.FileType.NotFound:
        return spark.createDataFrame([], f"{schema}, batch long")
    ledger = spark.read.schema("batch long, part string, rows long").json(f"{folder}/batches").select("batch", "part")
    rows = spark.read.schema(schema).parquet(f"{folder}/parts").select("*", F.col("_metadata.file_name").alias("part"))
    return rows.join(ledger, "part").drop("part")
