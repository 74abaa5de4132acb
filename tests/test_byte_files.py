"""Files of bytes: many tasks read one file whole, and only what is committed is seen."""

import os
import random

import pytest
from pyspark.sql import functions as F

from wavecrest.sources import byte_files


@pytest.fixture(scope="module")
def source(spark):
    byte_files.register(spark)
    return spark


def everything(place):
    return {n: open(f"{place}/{n}", "rb").read() for n in sorted(os.listdir(place)) if os.path.isfile(f"{place}/{n}") and not n.startswith(".")}


def test_one_file_by_many_tasks(source, tmp_path):
    data = random.Random(1).randbytes(1_000_003)
    (tmp_path / "a.bin").write_bytes(data)
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "_hidden").write_bytes(b"x")
    got = source.read.format("byte_files").option("chunk", 10_000).option("span", 100_000).load(f"file://{tmp_path}").withColumn("task", F.spark_partition_id()).orderBy("path", "at").collect()
    assert b"".join(r.data for r in got) == data and len({r.task for r in got}) == 11 and max(len(r.data) for r in got) == 10_000
    assert [r.at for r in got] == list(range(0, 1_000_003, 10_000))
    one = source.read.format("byte_files").load(f"{tmp_path}/a.bin").collect()
    assert [len(r.data) for r in one] == [65536] * 15 + [1_000_003 - 15 * 65536]


def test_nothing_to_read_or_write(source, tmp_path):
    assert source.read.format("byte_files").load(f"file://{tmp_path}").collect() == []
    none = source.createDataFrame([], "path string, at bigint, data binary")
    none.write.format("byte_files").option("path", f"file://{tmp_path}/out").mode("overwrite").save()
    assert b"".join(everything(f"{tmp_path}/out").values()) == b"" if os.path.isdir(f"{tmp_path}/out") else True
    with pytest.raises(Exception, match="chunk"):
        source.read.format("byte_files").option("chunk", 0).load(f"file://{tmp_path}").collect()


def test_parts_in_order(source, tmp_path):
    rows = [("", k, None if k == 7 else f"{k};".encode() * (k % 5)) for k in range(500)]
    frame = source.createDataFrame(rows, "path string, at bigint, data binary").repartition(3)
    place = f"file://{tmp_path}/out"
    for _ in range(2):  # the second overwrites the first
        frame.repartitionByRange(4, "at").sortWithinPartitions("at").write.format("byte_files").option("path", place).mode("overwrite").save()
    found = everything(f"{tmp_path}/out")
    assert b"".join(found.values()) == b"".join(d or b"" for *_, d in rows) and len(found) == 4
    frame.write.format("byte_files").option("path", place).mode("append").save()
    assert sum(map(len, everything(f"{tmp_path}/out").values())) == 2 * sum(len(d or b"") for *_, d in rows)
    assert not os.path.exists(f"{tmp_path}/out/_pending")


def test_a_failed_job_leaves_nothing(source, tmp_path):
    frame = source.range(0, 1000, 1, 4).select(F.lit("").alias("path"), "id", F.when(F.col("id") < 990, F.lit(b"abc")).otherwise(F.raise_error(F.lit("broken")).cast("binary")).alias("data")).withColumnRenamed("id", "at")
    with pytest.raises(Exception, match="broken"):
        frame.write.format("byte_files").option("path", f"file://{tmp_path}/out").mode("append").save()
    assert not os.path.exists(f"{tmp_path}/out") or everything(f"{tmp_path}/out") == {}


def test_frames_of_a_stream(source, tmp_path):
    for k in range(3):
        source.createDataFrame([(f"{k}{j}|".encode(),) for j in range(5)], "data binary").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = source.readStream.schema("data binary").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").select(F.lit("").alias("path"), F.lit(0).cast("bigint").alias("at"), "data")
    q = s.writeStream.format("byte_files").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    found = everything(f"{tmp_path}/out")
    assert {n[:14] for n in found} == {f"batch-{k:08d}" for k in range(3)}
    assert sorted(b"".join(found.values()).split(b"|")[:-1]) == sorted(f"{k}{j}".encode() for k in range(3) for j in range(5))
    assert os.listdir(f"{tmp_path}/out/_pending") == []
