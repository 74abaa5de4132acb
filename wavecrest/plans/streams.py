"""Queries that run a stream over the events table to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrest.operators.bridge import CHANNELS_SQL
from wavecrest.sources.shared import folder
from wavecrest.streaming.blocks import blocks, hourly, run_to_end, stream
from wavecrest.streaming.ordered import LookAhead, Reservoir, chained, run_through
from wavecrest.streaming.recovery import losses, recovered

ORACLES: dict[str, str] = {}


def stream_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full blocks of 8 samples of each channel, held over batches as state."""
    out = run_to_end(blocks(stream(spark, sf_dir)), folder(spark))
    return out.select("channel", "block", F.round("energy", 4).alias("energy"))


ORACLES["stream_blocks"] = f"WITH {CHANNELS_SQL} SELECT channel, i // 8 AS block, round(sum(x * x), 4) AS energy FROM c GROUP BY 1, 2 HAVING count(*) = 8"


def looked_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_through(spark, lambda events: chained(events, LookAhead()), stream(spark, sf_dir), folder(spark))


def stream_all_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All blocks of 8 samples of each channel, with the last ones, which the end of the stream leaves unfilled; a timer flushes those inside the stream."""
    out = looked_ahead(spark, sf_dir)
    return out.select("channel", "block", "n", F.round("energy", 4).alias("energy"), (F.col("n") == LookAhead.size).alias("full"))


ORACLES["stream_all_blocks"] = f'WITH {CHANNELS_SQL} SELECT channel, i // 8 AS block, count(*) AS n, round(sum(x * x), 4) AS energy, count(*) = 8 AS "full" FROM c GROUP BY 1, 2'


def stream_look_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 8 samples, each given out when the next one is there, or at the end of the stream: whether the next is an attack (over 6 times the
    energy), so that this one's window can start it."""
    out = looked_ahead(spark, sf_dir)
    return out.select("channel", "block", F.round("energy", 4).alias("energy"), F.coalesce(F.col("next_energy") > 6 * F.col("energy"), F.lit(False)).alias("starts"), F.col("next_energy").isNull().alias("flushed"))


ORACLES["stream_look_ahead"] = f"""WITH {CHANNELS_SQL}, b AS (SELECT channel, i // 8 AS block, sum(x * x) AS energy FROM c GROUP BY 1, 2), n AS (SELECT *, lead(energy) OVER (PARTITION BY channel ORDER BY block) AS nxt FROM b)
SELECT channel, block, round(energy, 4) AS energy, coalesce(nxt > 6 * energy, false) AS starts, nxt IS NULL AS flushed FROM n"""


def stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames whose data begins up to 511 bytes back in what earlier frames of the channel left: how many samples each gives (none where the history is too short), and a
    digest of its data. The history is held as state."""
    out = run_through(spark, lambda events: chained(events, Reservoir()), stream(spark, sf_dir), folder(spark))
    return out.select("channel", "event_id", "back", "bytes", "samples", "digest")


ORACLES["stream_history"] = """WITH h AS (SELECT user_id AS channel, event_id, ((event_id * 2654435761) & 4294967295) >> 23 AS back, props, right(coalesce(string_agg(props, '') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), 511) AS store FROM events),
b AS (SELECT *, CASE WHEN back <= length(store) THEN right(store, back) || props END AS body FROM h)
SELECT channel, event_id, back, length(body) AS bytes, CASE WHEN body IS NULL THEN 0 ELSE 1152 END AS samples, md5(body) AS digest FROM b"""


def stream_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as packets of 8 links, of which a part is lost: how much of each gap the copy in the packet behind it makes good."""
    return run_through(spark, lambda events: recovered(*losses(events)), stream(spark, sf_dir), folder(spark))


ORACLES["stream_recovered"] = """WITH e AS (SELECT event_id % 8 AS link, event_id // 8 AS seq, ts, ((event_id * 2654435761) & 4294967295) >> 28 < 3 AS lost FROM events),
c AS (SELECT *, ((seq // 4) * 7 + link) % 32 AS config, (CAST(floor((seq - 1) / 4.0) AS BIGINT) * 7 + link + 32) % 32 AS prev FROM e),
s AS (SELECT *, CAST(CASE WHEN config < 12 THEN [480, 960, 1920, 2880][config % 4 + 1] WHEN config < 16 THEN 480 * (1 + config % 2) ELSE 120 * (1 << CAST(config % 4 AS INTEGER)) END AS BIGINT) AS size FROM c),
j AS (SELECT g.link, g.seq, g.size AS missing, CASE WHEN p.config < 16 AND g.prev < 16 AND g.size >= p.size THEN p.size ELSE 0 END AS recovered
FROM s g LEFT JOIN s p ON NOT p.lost AND p.link = g.link AND p.seq = g.seq + 1 AND p.ts BETWEEN g.ts AND g.ts + INTERVAL 2 HOUR WHERE g.lost)
SELECT link, seq, missing, recovered, missing - recovered AS concealed FROM j"""


def stream_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts that are final: those that end a day or more before the last event."""
    out = run_to_end(hourly(stream(spark, sf_dir)), folder(spark))
    return out.select(F.unix_seconds("w.start").alias("hour"), "event_type", "n", "total")


ORACLES["stream_hours"] = """WITH m AS (SELECT max(ts) - INTERVAL 1 DAY AS m FROM events), h AS (SELECT date_trunc('hour', ts) AS h, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)
SELECT CAST(epoch(h) AS BIGINT) AS hour, event_type, n, total FROM h, m WHERE h + INTERVAL 1 HOUR <= date_trunc('millisecond', m)"""

QUERIES = {f.__name__: f for f in (stream_blocks, stream_all_blocks, stream_look_ahead, stream_history, stream_recovered, stream_hours)}
