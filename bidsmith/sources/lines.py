"""Lines of text files in any character set, read by byte ranges side by side."""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_READ = 1 << 20
_SCHEMA = "line string, file string, split bigint, at bigint"


@dataclass
class Stretch(InputPartition):
    path: str
    start: int
    end: int
    size: int


class LineSource(DataSource):
    """line, file, split (its first byte) and at (its number in the split).

    Options: path, a file or a folder of files (a URI or a local path); encoding; split, bytes of a task. A line belongs to the split
    in which its first byte lies. Bytes that the encoding doesn't have become U+FFFD; a byte order mark is left out.
    """

    @classmethod
    def name(cls) -> str:
        return "byte_lines"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LineReader(self.options)


def _opened(path: str):
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


class LineReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("split", 64 << 20))
        self.encoding = codecs.lookup(options.get("encoding", "utf-8")).name

    def _charset(self, head: bytes) -> tuple[str, int]:
        """The encoding with a byte order of its own, and how many bytes a mark takes."""
        for name, mark in (("utf-8", codecs.BOM_UTF8), ("utf-16-le", codecs.BOM_UTF16_LE), ("utf-16-be", codecs.BOM_UTF16_BE)):
            if head.startswith(mark) and (self.encoding.startswith(name) or (self.encoding == "utf-16" and name != "utf-8")):
                return name, len(mark)
        return "utf-16-le" if self.encoding == "utf-16" else self.encoding, 0

    def partitions(self) -> list[Stretch]:
        where, path = _opened(self.path)
        info = where.get_file_info(path)
        if info.type == pyarrow.fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else [f for f in where.get_file_info(pyarrow.fs.FileSelector(path)) if f.is_file and not f.base_name.startswith(("_", "."))]
        step = self.split + self.split % 2  # pairs of bytes stay together
        return [Stretch(f.path, a, min(a + step, f.size), f.size) for f in sorted(files, key=lambda f: f.path) for a in range(0, f.size, step)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        where, _ = _opened(self.path)
        with where.open_input_file(partition.path) as file:
            name, mark = self._charset(file.read_at(min(4, partition.size), 0))
            wide = 2 if name.startswith("utf-16") else 1
            feed = "\n".encode(name)
            # a split starts behind the first line end at or behind the byte before it, unless it is the file's first
            at, data, number, out = partition.start and partition.start - wide, b"", 0, []
            skip, begin = partition.start > 0, at
            while True:
                more = file.read_at(min(_READ, partition.size - at), at) if at < partition.size else b""
                data, at = data + more, at + len(more)
                pos = 0
                while (end := self._next(data, feed, pos, wide)) >= 0 or (not more and pos < len(data)):
                    end, step = (end, len(feed)) if end >= 0 else (len(data), 0)
                    if skip:
                        skip = False
                    elif begin + pos >= partition.end:
                        yield self._batch(out, partition)
                        return
                    else:
                        raw = data[pos:end]
                        if begin + pos == 0:
                            raw = raw[mark:]
                        out.append((raw.decode(name, "replace").removesuffix("\r"), number))
                        number += 1
                    pos = end + step
                data, begin = data[pos:], begin + pos
                if not more or (begin >= partition.end and not skip):
                    yield self._batch(out, partition)
                    return
                if len(out) >= 10_000:
                    yield self._batch(out, partition)
                    out = []

    @staticmethod
    def _next(data: bytes, feed: bytes, pos: int, wide: int) -> int:
        """Where the next line end lies, on a character's edge."""
        end = data.find(feed, pos)
        while end >= 0 and (end - pos) % wide:
            end = data.find(feed, end + 1)
        return end

    @staticmethod
    def _batch(out: list[tuple[str, int]], partition: Stretch) -> pa.RecordBatch:
        n = len(out)
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([partition.path] * n, pa.string()), pa.array([partition.start] * n, pa.int64()), pa.array([k for _, k in out], pa.int64())], names=["line", "file", "split", "at"])


def byte_lines(spark: SparkSession, path: str, encoding: str = "utf-8", split: int = 64 << 20) -> DataFrame:
    """line, file, split and at of every line; see LineSource."""
    spark.dataSource.register(LineSource)
    return spark.read.format("byte_lines").options(path=path, encoding=encoding, split=str(split)).load()
