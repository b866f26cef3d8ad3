"""Raw grey video as a Spark data source: ``name.gray`` (frames one after another) beside ``name.json``.

The JSON holds ``fps, width, height``. Frames are read at ``scan_fps`` (all if not given): sample k is at k / scan_fps
seconds. Bounds on ``t`` and an equality on ``video`` are pushed into the source, which then seeks to the first
byte wanted; a video is dealt to tasks by stretches of ``part_bytes``. A cut last frame ends its video.

As a stream, the source follows files that grow and files that are added. Its offset is how many frames of each video have been
taken. A micro-batch admits ``batch_bytes`` (all if not given), the same share of every video that has more, so a long video doesn't hold
up the others. What has been admitted is also noted in ``progress`` (a folder that outlives the driver), from which a
restarted query admits further; which frames a batch holds is Spark's checkpoint's to say, so a batch that failed is read again as it was.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "video string, k long, t double, pixels binary"


@dataclass
class Stretch(InputPartition):
    video: str
    path: str
    frame_bytes: int
    fps: float
    scan_fps: float
    first: int
    end: int


class GreyVideoReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.scan_fps = options["path"], float(options.get("scan_fps", 0))
        self.part_bytes = int(options.get("part_bytes", 64 << 20))
        self.low, self.high, self.video = 0.0, math.inf, None

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        for f in filters:
            if isinstance(f, GreaterThanOrEqual | GreaterThan) and f.attribute == ("t",):
                self.low = max(self.low, float(f.value))
            elif isinstance(f, LessThanOrEqual | LessThan) and f.attribute == ("t",):
                self.high = min(self.high, float(f.value))
            elif isinstance(f, EqualTo) and f.attribute == ("t",):
                self.low, self.high = max(self.low, float(f.value)), min(self.high, float(f.value))
            elif isinstance(f, EqualTo) and f.attribute == ("video",):
                self.video = f.value
            yield f  # Spark tests it again, so open and closed ends need no care here

    def partitions(self) -> list[Stretch]:
        fs, root = pafs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (pafs.LocalFileSystem(), self.folder)
        out = []
        for info in sorted(fs.get_file_info(pafs.FileSelector(root)), key=lambda i: i.path):
            if info.extension != "gray" or (self.video is not None and info.base_name != f"{self.video}.gray"):
                continue
            with fs.open_input_file(info.path[:-5] + ".json") as f:
                about = json.loads(f.read())
            size, rate = about["width"] * about["height"], self.scan_fps or about["fps"]
            n = math.ceil(info.size // size * rate / about["fps"])  # whole frames only
            first, end = max(0, math.floor(self.low * rate)), min(n, math.floor(min(self.high, n / rate) * rate) + 1)
            step = max(1, self.part_bytes // size)
            out += [Stretch(info.base_name[:-5], info.path, size, about["fps"], rate, k, min(end, k + step)) for k in range(first, end, step)]
        return out

    def read(self, part: Stretch | None) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        fs = pafs.FileSystem.from_uri(self.folder)[0] if "://" in self.folder or self.folder.startswith("file:") else pafs.LocalFileSystem()
        with fs.open_input_file(part.path) as f:
            for k in range(part.first, part.end):
                pixels = f.read_at(part.frame_bytes, math.floor(k * part.fps / part.scan_fps) * part.frame_bytes)
                if len(pixels) < part.frame_bytes:
                    return
                yield part.video, k, k / part.scan_fps, pixels


def _files(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


class GreyVideoStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options, self.folder = options, options["path"]
        self.batch_bytes = int(options.get("batch_bytes", 0))
        self.scan_fps, self.part_bytes = float(options.get("scan_fps", 0)), int(options.get("part_bytes", 64 << 20))
        self.admitted: dict[str, int] = {}
        if self.batch_bytes and "progress" not in options:
            raise ValueError("batch_bytes needs a folder for progress")
        if "progress" in options:
            fs, root = _files(options["progress"])
            if fs.get_file_info(f"{root}/admitted.json").type != pafs.FileType.NotFound:
                with fs.open_input_file(f"{root}/admitted.json") as f:
                    self.admitted = json.loads(f.read())

    def _videos(self) -> dict[str, Stretch]:
        fs, root = _files(self.folder)
        out = {}
        for info in fs.get_file_info(pafs.FileSelector(root)):
            if info.extension == "gray":
                with fs.open_input_file(info.path[:-5] + ".json") as f:
                    about = json.loads(f.read())
                size, rate = about["width"] * about["height"], self.scan_fps or about["fps"]
                out[info.base_name[:-5]] = Stretch(info.base_name[:-5], info.path, size, about["fps"], rate, 0, math.ceil(info.size // size * rate / about["fps"]))
        return out

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        videos = self._videos()
        more = {name: v.end - self.admitted.get(name, 0) for name, v in sorted(videos.items()) if v.end > self.admitted.get(name, 0)}
        left = self.batch_bytes or math.inf
        while more and left > 0:
            share = left / len(more)
            for name in list(more):
                size = videos[name].frame_bytes
                n = min(more[name], max(1, int(min(share, left) // size))) if math.isfinite(left) else more[name]
                if left <= 0:
                    break
                self.admitted[name] = self.admitted.get(name, 0) + n
                left -= n * size
                more[name] -= n
                if not more[name]:
                    del more[name]
        return dict(self.admitted)

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        for name, n in end.items():
            self.admitted[name] = max(n, self.admitted.get(name, 0))
        if "progress" in self.options:
            fs, root = _files(self.options["progress"])
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(f"{root}/.admitted") as out:
                out.write(json.dumps(self.admitted).encode())
            fs.move(f"{root}/.admitted", f"{root}/admitted.json")
        out = []
        videos = self._videos()
        for name, n in sorted(end.items()):
            step = max(1, self.part_bytes // videos[name].frame_bytes)
            out += [replace(videos[name], first=k, end=min(n, k + step)) for k in range(start.get(name, 0), n, step)]
        return out

    def read(self, part: Stretch) -> Iterator[tuple]:
        return GreyVideoReader({"path": self.folder}).read(part)


class GreyVideo(DataSource):
    @classmethod
    def name(cls) -> str:
        return "grey_video"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GreyVideoReader:
        return GreyVideoReader(self.options)

    def streamReader(self, schema) -> GreyVideoStream:  # noqa: N802
        return GreyVideoStream(self.options)


def frames(spark: SparkSession, folder: str, scan_fps: float | None = None, **options) -> DataFrame:
    """``video, k, t, pixels`` of a folder's raw grey videos."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GreyVideo)
    reader = spark.read.format("grey_video").options(**options)
    return (reader.option("scan_fps", scan_fps) if scan_fps else reader).load(folder)


def frame_stream(spark: SparkSession, folder: str, **options) -> DataFrame:
    """A stream of ``video, k, t, pixels`` of a folder's raw grey videos (``scan_fps``, ``batch_bytes`` with ``progress``, ``part_bytes``)."""
    spark.dataSource.register(GreyVideo)
    return spark.readStream.format("grey_video").options(**options).load(folder)


def frame_at(df: DataFrame, video: str, t: float) -> DataFrame:
    """The one frame at a time; no row beyond the end or between frames."""
    return df.where((df.video == video) & (df.t == t))
