"""Places and files that the driver and all executors see.

Intermediate tables and the files that operators write go below the folder that the
session names in ``spark.checkpoint.dir``; only where that is unset and all tasks run in the driver's own process (in tests) does a
local temporary folder take its place.
"""

from __future__ import annotations

import tempfile
import uuid
import warnings
import weakref
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings while a table is written. The shuffle files of a query go when it ends, not when the driver happens to collect its garbage;
#: and the driver keeps the beginning of a plan's description only, since a plan may hold tables of some 100 kB.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxPlanStringLength": "8192"}

_own: list[str] = []
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def folder(spark: SparkSession) -> str:
    """A new path below the shared folder. Raises where executors have machines of their own and no shared folder is named."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="spark-"))
        base = _own[0]
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut(frame: DataFrame) -> DataFrame:
    """The rows of frame, written to the shared folder and read from there: later jobs, and tasks that run anew after an
    executor is lost, start from these files. The shuffle files of the writing are removed once it has ended. The driver's JVM is then asked to
    collect its garbage (by a handle that PySpark calls private; there is no other): an operator runs dozens of queries, and their plans and
    generated classes would otherwise fill whatever heap the driver has."""
    spark, path = frame.sparkSession, folder(frame.sparkSession)
    before = {k: spark.conf.get(k) for k in WRITING}
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        frame.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(frame.schema).parquet(path)
    _paths[out] = path
    return out


def drop(*frames: DataFrame) -> None:
    """Removes the files of frames that ``cut`` returned and that nothing reads any more. Where pyarrow doesn't know the file system, they stay."""
    import pyarrow as pa

    for frame in frames:
        try:
            system, path = file_system(_paths.pop(frame))
            system.delete_dir(path)
        except (OSError, pa.ArrowException) as e:
            warnings.warn(f"an intermediate table stays: {e}", stacklevel=2)


def maybe_in(keys: DataFrame, bits_per_key: int = 8, most_bits: int = 1 << 23) -> Callable[[Column], Column]:
    """A condition on 64-bit hashes: whether one may be among ``keys`` (column key), by a table of ``bits_per_key`` bits for each key and up to
    twice as many, so that at most one in ``bits_per_key`` of the others is let through. It spares an exact join the rows that can't match. Keys that would need more than
    ``most_bits`` (a megabyte, by which the plan grows) have no table: all hashes may be among them then, and the exact join does the whole work."""
    bits = 1 << max(10, (bits_per_key * keys.count() - 1).bit_length())
    if bits > most_bits:
        return lambda key: key.isNull() | key.isNotNull()
    place = lambda key: F.pmod(key, F.lit(bits))
    bit = lambda p, n: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(p, F.lit(n)).cast("int"))
    words = keys.select(place(F.col("key")).alias("p")).groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(bit(F.col("p"), 64)).alias("b"))
    table = bytearray(bits // 8)
    for w, b in words.collect():
        table[8 * w : 8 * w + 8] = (b & (1 << 64) - 1).to_bytes(8, "little")

    def there(key: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.lit(bytes(table)), F.floor(place(key) / 8).cast("int") + 1, F.lit(1))), 16, 10)
        return byte.cast("bigint").bitwiseAND(bit(place(key), 8)) != 0

    return there


def give_back() -> None:
    """Hands memory that this process has freed back to the system, where its C library can: of thousands of texts that are freed one by one, it
    otherwise keeps the room."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


def column_name(frame: DataFrame, stem: str) -> str:
    """A column name that frame doesn't have, in any case."""
    taken = {c.lower() for c in frame.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def file_system(uri: str):
    """A file system that pyarrow knows, and the path in it; Hadoop's name for S3 is s3a."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if uri.startswith("s3a://") else uri)


def open_output(uri: str):
    """A binary stream to a new file."""
    system, path = file_system(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def open_input(uri: str):
    system, path = file_system(uri)
    return system.open_input_file(path)


def move(source: str, target: str) -> None:
    system, path = file_system(source)
    system.move(path, file_system(target)[1])
