"""Headerless samples: bytes of whole numbers, lowest byte first, to arrays and back, and files of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrest.functions import signal as S


def pcm_bytes(x: Column, bits: int) -> Column:
    """An array of samples in [-1, 1] as bytes of 8 (unsigned, 128 is zero), 16, 24 or 32 bits each."""

    def one(v: Column) -> Column:
        q = S.quantise(v, bits) + (128 if bits == 8 else 0)
        parts = [F.lpad(F.hex(F.shiftright(q, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(bits // 8)]
        return F.concat(*parts)

    return F.unhex(F.array_join(F.transform(x, one), ""))


def pcm_values(data: Column, bits: int) -> Column:
    """The whole numbers that bytes stand for; a last one that isn't whole is left out."""
    n = bits // 8

    def one(k: Column) -> Column:
        part = F.reverse(F.regexp_extract_all(F.hex(F.substring(data, k * n + 1, F.lit(n))), F.lit("(..)")))
        v = F.conv(F.array_join(part, ""), 16, 10).cast("bigint")
        return v - 128 if bits == 8 else F.when(v >= 1 << (bits - 1), v - (1 << bits)).otherwise(v)

    count = F.floor(F.octet_length(data) / n).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), one)).otherwise(F.array().cast("array<bigint>"))


def read_pcm(spark: SparkSession, path: str, rate: int, channels: int, bits: int) -> DataFrame:
    """path, rate, channel, i, value of headerless files of interleaved samples. A file is one row of bytes, so one of over 2 GB can't be read."""
    if channels < 1 or rate < 1 or bits not in (8, 16, 24, 32):
        raise ValueError("rate, channels and bits must be positive, bits one of 8, 16, 24, 32")
    files = spark.read.format("binaryFile").load(path)
    v = files.select("path", F.posexplode(pcm_values(F.col("content"), bits)).alias("k", "v"), (F.floor(F.col("length") / (channels * bits // 8)) * channels).alias("whole"))
    return v.where("k < whole").select("path", F.lit(rate).alias("rate"), F.pmod("k", F.lit(channels)).alias("channel"), F.floor(F.col("k") / channels).alias("i"), (F.col("v") / float(1 << (bits - 1))).alias("value"))
