"""A sink that takes each batch of rows once: files are staged by tasks and count only once a batch's manifest names them.

A task that fails and runs again stages other files; a batch that fails leaves files that no manifest names; a batch that is
run again after its manifest was written changes nothing. So what readers see are whole batches, each once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage


@dataclass
class Staged(WriterCommitMessage):
    file: str
    rows: int


class _Folder:
    """Staged row files and manifests under one URI or local path."""

    def __init__(self, path: str):
        self.path = path

    def _opened(self):
        return pyarrow.fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), self.path)

    def stage(self, names: list[str], rows: Iterator[tuple]) -> Staged:
        where, path = self._opened()
        name, n = f"{uuid.uuid4().hex}.json", 0
        where.create_dir(f"{path}/rows", recursive=True)
        with where.open_output_stream(f"{path}/rows/{name}") as out:
            for row in rows:
                out.write((json.dumps(dict(zip(names, row, strict=True)), default=str) + "\n").encode())
                n += 1
        return Staged(name, n)

    def commit(self, batch: str, messages: list[Staged | None]) -> None:
        """Write the batch's manifest; where there is one, what is staged now goes."""
        where, path = self._opened()
        manifest = f"{path}/batches/{batch}.json"
        if where.get_file_info(manifest).type != pyarrow.fs.FileType.NotFound:
            return self.abort(messages)
        where.create_dir(f"{path}/batches", recursive=True)
        draft = f"{path}/drafts/{uuid.uuid4().hex}"
        where.create_dir(f"{path}/drafts", recursive=True)
        with where.open_output_stream(draft) as out:
            out.write("".join(json.dumps({"batch": batch, "file": m.file, "rows": m.rows}) + "\n" for m in messages if m).encode())
        where.move(draft, manifest)

    def abort(self, messages: list[Staged | None]) -> None:
        where, path = self._opened()
        for m in messages:
            if m and where.get_file_info(f"{path}/rows/{m.file}").type != pyarrow.fs.FileType.NotFound:
                where.delete_file(f"{path}/rows/{m.file}")


class OrderSink(DataSource):
    """Options: path; batch, the name of the batch that a write which is no stream stands for (a new one by default)."""

    @classmethod
    def name(cls) -> str:
        return "orders"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("orders can only be added")
        return OrderWriter(self.options, schema.names)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return OrderStreamWriter(self.options, schema.names)


class OrderWriter(DataSourceWriter):
    def __init__(self, options, names: list[str]):
        self.folder, self.names, self.batch = _Folder(options["path"]), names, options.get("batch") or uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Staged:
        return self.folder.stage(self.names, iterator)

    def commit(self, messages) -> None:
        self.folder.commit(self.batch, messages)

    def abort(self, messages) -> None:
        self.folder.abort(messages)


class OrderStreamWriter(DataSourceStreamWriter):
    def __init__(self, options, names: list[str]):
        self.folder, self.names = _Folder(options["path"]), names

    def write(self, iterator: Iterator) -> Staged:
        return self.folder.stage(self.names, iterator)

    def commit(self, messages, batchId: int) -> None:
        self.folder.commit(f"stream-{batchId}", messages)

    def abort(self, messages, batchId: int) -> None:
        self.folder.abort(messages)


def write_orders(rows: DataFrame, path: str, batch: str | None = None) -> None:
    """Add rows; of one batch name only the first write counts."""
    rows.sparkSession.dataSource.register(OrderSink)
    rows.write.format("orders").mode("append").options(path=path, **({"batch": batch} if batch else {})).save()


def stream_orders(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Add the rows of a stream until its source is read; its batches are named by their numbers."""
    rows.sparkSession.dataSource.register(OrderSink)
    rows.writeStream.format("orders").options(path=path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def orders_of(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all whole batches."""
    named = spark.read.schema("batch string, file string, rows bigint").json(f"{path}/batches").select("file").distinct()
    rows = spark.read.schema(schema).json(f"{path}/rows").withColumn("file", F.element_at(F.split("_metadata.file_path", "/"), -1))
    return rows.join(named, "file", "left_semi").drop("file")
