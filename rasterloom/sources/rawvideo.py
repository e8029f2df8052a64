"""Raw video files as a data source: ``spark.read.format("rawvideo").option("width", ..)``.

A file is a sequence of frames of equal size; ranges of frames are the partitions, so files of any
length are read in parallel. Paths may be anything that pyarrow's file systems open."""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schema as S


def frame_bytes(pix_fmt: str, width: int, height: int) -> int:
    n = width * height
    sizes = {"yuv420p": n + n // 2, "yuv422p10le": 4 * n, "uyvy422": 2 * n, "ndi_uyvy422": 2 * n}
    if pix_fmt not in sizes:
        raise ValueError(f"unknown pixel format {pix_fmt}")
    return sizes[pix_fmt]


class _Range(InputPartition):
    def __init__(self, path: str, first: int, count: int, base: int):
        self.path, self.first, self.count, self.base = path, first, count, base


class RawVideoReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.width, self.height = options["path"], int(options["width"]), int(options["height"])
        self.pix_fmt = options.get("pix_fmt", "yuv420p")
        self.each, self.chunk = frame_bytes(self.pix_fmt, self.width, self.height), int(options.get("framesperpartition", "64"))

    def partitions(self) -> list[_Range]:
        from pyarrow import fs as pafs

        system, root = pafs.FileSystem.from_uri(self.path)
        info = system.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else sorted((f for f in system.get_file_info(pafs.FileSelector(root)) if f.is_file), key=lambda f: f.path)
        out, base = [], 0
        for f in files:
            frames = f.size // self.each
            out += [_Range(f.path, a, min(self.chunk, frames - a), base) for a in range(0, frames, self.chunk)]
            base += frames
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        from pyarrow import fs as pafs

        system, _ = pafs.FileSystem.from_uri(self.path)
        with system.open_input_file(partition.path) as f:
            f.seek(partition.first * self.each)
            for k in range(partition.count):
                yield partition.base + partition.first + k, None, self.width, self.height, self.pix_fmt, bytes(f.read(self.each))


class RawVideo(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rawvideo"

    def schema(self):
        return S.FRAME

    def reader(self, schema) -> RawVideoReader:
        return RawVideoReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RawVideo)
