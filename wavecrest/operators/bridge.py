"""Signals as tables: frames of samples, channels of ordered samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrest.operators.ranks import numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_no, label, x (array of samples): one row per embedding. What is local to a frame is computed within the row, so
    it needs no exchange."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_no"), "label", F.col("embedding").cast("array<double>").alias("x"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_no, i, x"""
    return frames(spark, sf_dir).select("frame_no", F.posexplode("x").alias("i", "x")).withColumn("i", F.col("i").cast("bigint"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_no, l, r: two frames side by side, frame 2k as left and 2k + 1 as right. One partially aggregated exchange."""
    f = frames(spark, sf_dir)
    side = F.pmod("frame_no", F.lit(2))
    both = f.groupBy((F.col("frame_no") - side).alias("frame_no")).agg(
        F.max(F.when(side == 0, F.col("x"))).alias("l"), F.max(F.when(side == 1, F.col("x"))).alias("r")
    )
    return both.where("l is not null and r is not null")


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """channel, i, x: the values of a user's events in order of time. Events are numbered by hours first and then within an hour, so that no task
    holds a channel."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("channel"), "ts", "event_id", F.col("value").alias("x"))
    hour = F.unix_date(F.to_date("ts")) * 24 + F.hour("ts")
    return numbered(e, ["channel"], hour, ["ts", "event_id"], "i").select("channel", "i", "x", "ts")


FRAMES_SQL = "f AS (SELECT vec_id AS frame_no, label, CAST(unnest(range(0, len(embedding))) AS BIGINT) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
PAIRS_SQL = FRAMES_SQL + ", p AS (SELECT a.frame_no, a.i, a.x AS l, b.x AS r FROM f a JOIN f b ON b.frame_no = a.frame_no + 1 AND b.i = a.i WHERE a.frame_no % 2 = 0)"
CHANNELS_SQL = "c AS (SELECT user_id AS channel, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS x, ts FROM events)"
