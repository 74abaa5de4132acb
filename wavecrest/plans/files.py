"""Queries whose data goes through files of bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrest.operators.bridge import frames
from wavecrest.plans.sequence import PCM_SQL
from wavecrest.sources import byte_files
from wavecrest.sources.bits import byte_values, le_hex, low_bits
from wavecrest.sources.raw import pcm_bytes, pcm_values
from wavecrest.sources.shared import folder

ORACLES: dict[str, str] = {}


def frame_files(spark: SparkSession, sf_dir: str, length: int = 64) -> DataFrame:
    """Frames as records of their number and 16-bit samples, written to files in order, and read back in ranges by many tasks."""
    byte_files.register(spark)
    place, size = folder(spark), 8 + 2 * length
    f = frames(spark, sf_dir).where(F.size("x") == length).select("frame_no", F.unhex(F.concat(le_hex(F.col("frame_no"), 8), F.hex(pcm_bytes(F.col("x"), 16)))).alias("data"))
    f.repartitionByRange("frame_no").sortWithinPartitions("frame_no").select(F.lit("").alias("path"), F.lit(0).cast("bigint").alias("at"), "data").write.format("byte_files").option("path", place).mode("overwrite").save()
    back = spark.read.format("byte_files").option("chunk", 64 * size).option("span", 1024 * size).load(place)
    records = back.select(F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.octet_length("data") / size).cast("int") - 1), lambda k: F.substring(F.col("data"), k * size + 1, F.lit(size)))).alias("r"))
    number = byte_values(F.substring("r", 1, 8))
    number = low_bits(number, 0, 32) + F.shiftleft(low_bits(number, 32, 31), 32)
    out = records.select(number.alias("frame_no"), F.posexplode(pcm_values(F.substring("r", 9, 2 * length), 16)).alias("i", "v"))
    return out.select("frame_no", F.col("i").cast("bigint").alias("i"), "v")


ORACLES["frame_files"] = f"WITH {PCM_SQL} SELECT frame_no, i, v FROM q WHERE frame_no IN (SELECT frame_no FROM f GROUP BY 1 HAVING count(*) = 64)"

QUERIES = {f.__name__: f for f in (frame_files,)}
