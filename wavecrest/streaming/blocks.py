"""Frame-at-a-time operators on streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, with time as a timestamp."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def blocks(events: DataFrame, size: int = 8) -> DataFrame:
    """channel, block, energy of each full block of ``size`` samples of a user. Samples that don't fill a block yet are held as state, and
    come out when later ones do; within a batch they are taken in order of time."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, held = state.get if state.exists else (0, [])
        new = pd.concat([p for p in parts if len(p)]).sort_values(["ts", "event_id"])["value"].to_numpy()
        x = np.concatenate([np.array(held, float), new])
        n = len(x) // size
        state.update((done + n, x[n * size :].tolist()))
        energy = (x[: n * size].reshape(n, size) ** 2).sum(axis=1)
        yield pd.DataFrame({"channel": key[0], "block": np.arange(done, done + n), "energy": energy})

    return (
        events.select("user_id", "ts", "event_id", "value")
        .groupBy("user_id")
        .applyInPandasWithState(step, "channel bigint, block bigint, energy double", "done bigint, held array<double>", "append", GroupStateTimeout.NoTimeout)
    )


def hourly(events: DataFrame) -> DataFrame:
    """Counts by hour and type; an hour is final a day after it by the stream's own time."""
    return events.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def run_to_end(frame: DataFrame, place: str, mode: str = "append") -> DataFrame:
    """What a stream has given when all that is there has been read; its table and checkpoint lie below ``place``."""
    q = frame.writeStream.format("parquet").outputMode(mode).option("path", f"{place}/table").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return frame.sparkSession.read.schema(frame.schema).parquet(f"{place}/table")
