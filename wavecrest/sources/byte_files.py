"""Files of any size as ranges of bytes, and bytes as files: a data source with partitioned readers and with batch and stream writers.

``spark.read.format("byte_files").load(path)`` gives path, at and data: chunks of 64 KiB, read by tasks that each take a range of a file, so no row holds a file and one large file is
read by many tasks. ``df.write.format("byte_files")`` writes the column data of each partition, in its order, to a file of its own, ``part-00000`` and on; of rows that
were sorted by range the files in order of their names are the bytes in order. A task writes to a name that no other attempt has; only what the driver commits is
renamed, and what a failed or doubled attempt has left is removed with the job. A stream's files carry the batch's number, so a batch that is committed again replaces itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage

CHUNK, SPAN = 1 << 16, 1 << 24
PENDING = "_pending"


def located(uri: str):
    """A file system that pyarrow knows, and the path in it; Hadoop's name for S3 is s3a."""
    from pyarrow import fs

    uri = uri.replace("s3a://", "s3://", 1) if uri.startswith("s3a://") else uri
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class RangeReader(DataSourceReader):
    def __init__(self, path: str, chunk: int, span: int):
        if chunk < 1 or span < chunk:
            raise ValueError("chunk must be positive and at most span")
        self.path, self.chunk, self.span = path, chunk, span // chunk * chunk

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        system, path = located(self.path)
        info = system.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((f.path, f.size) for f in files if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")) and f"/{PENDING}" not in f.path)
        return [Range(p, at, min(at + self.span, size)) for p, size in files for at in range(0, size, self.span)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.start == partition.end:
            return
        system, _ = located(self.path)
        with system.open_input_file(partition.path) as f:
            f.seek(partition.start)
            for at in range(partition.start, partition.end, self.chunk):
                data = f.read(min(self.chunk, partition.end - at))
                yield pa.RecordBatch.from_arrays([pa.array([partition.path]), pa.array([at]), pa.array([data])], ["path", "at", "data"])


@dataclass
class Written(WriterCommitMessage):
    pending: str
    partition: int
    size: int


def write_rows(root: str, batches: Iterator[pa.RecordBatch]) -> Written:
    """The rows' bytes in a new file that only this attempt has."""
    from pyspark import TaskContext

    system, path = located(root)
    name, size = f"{path.rstrip('/')}/{PENDING}/{uuid.uuid4().hex}", 0
    system.create_dir(f"{path.rstrip('/')}/{PENDING}", recursive=True)
    with system.open_output_stream(name, compression=None) as out:
        for batch in batches:
            for data in batch.column(batch.schema.get_field_index("data")):
                if data.is_valid:
                    out.write(data.as_buffer())
                    size += len(data.as_buffer())
    return Written(name, TaskContext.get().partitionId(), size)


def publish(root: str, messages: list[Written | None], prefix: str) -> None:
    system, path = located(root)
    for m in messages:
        if m is not None:
            system.move(m.pending, f"{path.rstrip('/')}/{prefix}{m.partition:05d}")


def clear(root: str, messages: list[Written | None] | None) -> None:
    """Removes what these attempts have left, or, where all have ended, whatever is pending."""
    system, path = located(root)
    if messages is None:
        from pyarrow import fs

        if system.get_file_info(f"{path.rstrip('/')}/{PENDING}").type == fs.FileType.Directory:
            system.delete_dir(f"{path.rstrip('/')}/{PENDING}")
        return
    for m in messages:
        if m is not None:
            system.delete_file(m.pending)


class FileWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return write_rows(self.path, iterator)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, path = located(self.path)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if f.type == fs.FileType.File:
                    system.delete_file(f.path)
        publish(self.path, messages, "part-" if self.overwrite else f"part-{uuid.uuid4().hex[:8]}-")
        clear(self.path, None)

    def abort(self, messages: list[Written | None]) -> None:
        clear(self.path, None)


class FrameWriter(DataSourceStreamArrowWriter):
    """Each row of a stream as it comes; a batch's files appear together when it is committed."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return write_rows(self.path, iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        publish(self.path, messages, f"batch-{batchId:08d}-")

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        clear(self.path, messages)


class ByteFiles(DataSource):
    """Options: path, chunk (bytes of a row, 64 KiB), span (bytes of a task, 16 MiB). Without overwrite new files stand beside those that are there."""

    @classmethod
    def name(cls) -> str:
        return "byte_files"

    def schema(self) -> str:
        return "path string, at bigint, data binary"

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options["path"], int(self.options.get("chunk", CHUNK)), int(self.options.get("span", SPAN)))

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], overwrite)

    def streamWriter(self, schema, overwrite: bool) -> FrameWriter:
        return FrameWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ByteFiles)
