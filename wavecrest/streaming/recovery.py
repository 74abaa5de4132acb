"""Lost packets and the copies that the packets behind them carry, joined as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavecrest.streaming.ordered import END

# Samples at 48 kHz of a frame by its configuration; below 12 speech, below 16 hybrid, then transform coding.
SPEECH, HYBRID, TRANSFORM = [480, 960, 1920, 2880], 480, 120


def frame_size(config: Column) -> Column:
    speech = F.get(F.array(*map(F.lit, SPEECH)), F.pmod(config, F.lit(4)).cast("int"))
    hybrid = HYBRID * (1 + F.pmod(config, F.lit(2)))
    transform = TRANSFORM * F.pow(F.lit(2.0), F.pmod(config, F.lit(4))).cast("bigint")
    return F.when(config < 12, speech).when(config < 16, hybrid).otherwise(transform).cast("bigint")


def has_copy(config: Column) -> Column:
    """Transform coding carries no copy of the frame before, and can't be continued from one."""
    return config < 16


def recovered(gaps: DataFrame, packets: DataFrame, wait: str = "2 hours", delay: str = "1 day") -> DataFrame:
    """link, seq, missing, recovered, concealed of each gap.

    gaps: link, seq, ts, missing (samples), before (configuration of the packet before). packets: link, seq, ts, config. A gap is paired with the packet of the next number
    if that comes within ``wait``; a gap that none covers comes out when the watermark has passed that time. The copy in a packet is as long as its frames and stands for the tail
    of the gap; what lies before it is concealed, and so is all of a gap that is shorter than the copy, or where either packet is of transform coding."""
    g = gaps.withWatermark("ts", delay).select("link", "seq", "ts", "missing", "before")
    p = packets.withWatermark("ts", delay).select(F.col("link").alias("plink"), (F.col("seq") - 1).alias("pseq"), F.col("ts").alias("pts"), "config")
    on = (F.col("link") == F.col("plink")) & (F.col("seq") == F.col("pseq")) & (F.col("pts") >= F.col("ts")) & (F.col("pts") <= F.col("ts") + F.expr(f"INTERVAL {wait}"))
    both = g.join(p, on, "left")
    size = frame_size(F.col("config"))
    good = F.col("config").isNotNull() & has_copy(F.col("config")) & has_copy(F.col("before")) & (F.col("missing") >= size)
    out = both.select("link", "seq", "missing", F.when(good, size).otherwise(0).cast("bigint").alias("recovered"))
    return out.withColumn("concealed", F.col("missing") - F.col("recovered"))


def links(events: DataFrame, n: int = 8) -> DataFrame:
    """Events as the packets of ``n`` links: link, seq, ts, config, before (the configuration of the packet before), lost. The row that ends a stream belongs to link -1: a null
    would be taken out by the join before the watermark has seen it."""
    seq = F.coalesce(F.floor(F.col("event_id") / n), F.lit(-1))
    config = lambda s: F.pmod(F.floor(s / 4) * 7 + F.col("link"), F.lit(32))
    e = events.select(F.coalesce(F.pmod("event_id", F.lit(n)), F.lit(-1)).alias("link"), seq.alias("seq"), "ts", (F.shiftright((F.col("event_id") * 2654435761).bitwiseAND(F.lit((1 << 32) - 1)), 28) < 3).alias("lost"))
    return e.select("link", "seq", "ts", config(F.col("seq")).alias("config"), config(F.col("seq") - 1).alias("before"), "lost")


def losses(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The gaps and the packets that came of a stream of events, both with the row that ends the stream."""
    e = links(events)
    only = lambda c: F.when(F.col("ts") < F.lit(END), c).otherwise(True)
    return e.where(only(F.col("lost"))).withColumn("missing", frame_size(F.col("config"))), e.where(only(~F.col("lost")))
