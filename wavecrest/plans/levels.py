"""Levels, gains, sample formats and channel layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavecrest.functions import signal as S
from wavecrest.operators.bridge import CHANNELS_SQL, FRAMES_SQL, PAIRS_SQL, channels, frames, pairs, samples

ORACLES: dict[str, str] = {}


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level, peak and crest factor of each channel, in dB."""
    g = channels(spark, sf_dir).groupBy("channel").agg(S.db(F.avg(F.col("x") * F.col("x")) + S.TINY).alias("rms"), (20 * F.log10(F.max(F.abs("x")) + S.TINY)).alias("peak"))
    return g.select("channel", F.round("rms", 6).alias("rms_db"), F.round("peak", 6).alias("peak_db"), F.round(F.col("peak") - F.col("rms"), 6).alias("crest_db"))


ORACLES["levels"] = f"""WITH {CHANNELS_SQL}, g AS (SELECT channel, 10 * log10(avg(x * x) + 1e-12) AS rms, 20 * log10(max(abs(x)) + 1e-12) AS peak FROM c GROUP BY channel)
SELECT channel, round(rms, 6) AS rms_db, round(peak, 6) AS peak_db, round(peak - rms, 6) AS crest_db FROM g"""


def dynamics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dynamic range (95th less 10th percentile) and loudness deviation of short-term levels: windows of 8 samples every 4, those
    within 60 dB of the loudest; the last full window is left out."""
    c = channels(spark, sf_dir)
    n = c.groupBy("channel").agg(F.max("i").alias("last"))
    # sample i lies in the windows that start at 4 * floor(i / 4) and 4 before
    w = c.select("channel", "x", F.explode(F.array(F.floor(F.col("i") / 4), F.floor(F.col("i") / 4) - 1)).alias("w")).where("w >= 0")
    st = w.groupBy("channel", "w").agg(S.db(F.avg(F.col("x") * F.col("x")) + S.TINY).alias("st")).join(n, "channel").where(F.col("w") < F.floor((F.col("last") + 1 - 8) / 4))
    st = st.withColumn("top", F.max("st").over(Window.partitionBy("channel"))).where(F.col("st") > F.col("top") - 60)
    g = st.groupBy("channel").agg(F.percentile("st", F.lit(0.95)).alias("hi"), F.percentile("st", F.lit(0.10)).alias("lo"), F.stddev_pop("st").alias("sd"))
    return g.select("channel", F.round(F.col("hi") - F.col("lo"), 5).alias("range_db"), F.round("sd", 5).alias("loud_std"))


ORACLES["dynamics"] = f"""WITH {CHANNELS_SQL}, n AS (SELECT channel, max(i) + 1 AS n FROM c GROUP BY channel),
w AS (SELECT channel, k AS w FROM n, unnest(range(0, CAST(greatest(floor((n - 8) / 4.0), 0) AS BIGINT))) AS u(k)),
st AS (SELECT c.channel, w.w, 10 * log10(avg(x * x) + 1e-12) AS st FROM w JOIN c ON c.channel = w.channel AND c.i >= 4 * w.w AND c.i < 4 * w.w + 8 GROUP BY 1, 2),
a AS (SELECT channel, st FROM st QUALIFY st > max(st) OVER (PARTITION BY channel) - 60)
SELECT channel, round(quantile_cont(st, 0.95) - quantile_cont(st, 0.10), 5) AS range_db, round(stddev_pop(st), 5) AS loud_std FROM a GROUP BY channel"""


def peak_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each channel scaled to a peak of -1 dB; a silent one is left alone. The window shares the channel's exchange."""
    c = channels(spark, sf_dir).select("channel", "i", "x")
    peak = F.max(F.abs("x")).over(Window.partitionBy("channel"))
    return c.withColumn("peak", peak).select("channel", "i", F.round(F.when(F.col("peak") > 0, F.col("x") * S.db_gain(-1) / F.col("peak")).otherwise(F.col("x")), 6).alias("x"))


ORACLES["peak_norm"] = f"""WITH {CHANNELS_SQL}, p AS (SELECT channel, max(abs(x)) AS p FROM c GROUP BY channel)
SELECT channel, i, round(CASE WHEN p > 0 THEN x * pow(10, -1 / 20.0) / p ELSE x END, 6) AS x FROM c JOIN p USING (channel)"""


def gain_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("frame_no", "i", F.round(S.gain(F.col("x"), -6), 6).alias("x"))


ORACLES["gain_db"] = f"WITH {FRAMES_SQL} SELECT frame_no, i, round(x * pow(10, -6 / 20.0), 6) AS x FROM f"


def pcm16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("frame_no", "i", S.quantise(F.col("x"), 16).alias("pcm"))


ORACLES["pcm16"] = f"WITH {FRAMES_SQL} SELECT frame_no, i, CAST(sign(x) * floor(abs(greatest(least(x, 1.0), -1.0) * 32767) + 0.5) AS BIGINT) AS pcm FROM f"


def pcm16_trunc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variant that cuts off the fraction."""
    return samples(spark, sf_dir).select("frame_no", "i", (S.clamp(F.col("x")) * 32767).cast("bigint").alias("pcm"))


ORACLES["pcm16_trunc"] = f"WITH {FRAMES_SQL} SELECT frame_no, i, CAST(trunc(greatest(least(x, 1.0), -1.0) * 32767) AS BIGINT) AS pcm FROM f"


def wav_scale_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writing multiplies by 2^(b-1) - 1, reading divides by 2^(b-1): what that costs, by depth."""
    f = frames(spark, sf_dir).select("x", F.explode(F.array(F.lit(8), F.lit(16), F.lit(24))).alias("bits")).select("bits", F.explode("x").alias("x"))
    e = S.quantise(F.col("x"), F.col("bits")) / F.pow(S.lit(2), F.col("bits") - 1) - F.col("x")
    return f.select("bits", e.alias("e")).groupBy("bits").agg(F.count("*").alias("n"), F.round(F.max(F.abs("e")), 9).alias("worst"), F.round(F.avg(F.abs("e")), 9).alias("mean_error"))


ORACLES["wav_scale_roundtrip"] = f"""WITH {FRAMES_SQL}, e AS (SELECT bits, sign(x) * floor(abs(x) * (pow(2, bits - 1) - 1) + 0.5) / pow(2, bits - 1) - x AS e FROM (SELECT bits, greatest(least(x, 1.0), -1.0) AS x FROM f, (VALUES (8), (16), (24)) t(bits)))
SELECT CAST(bits AS INTEGER) AS bits, count(*) AS n, round(max(abs(e)), 9) AS worst, round(avg(abs(e)), 9) AS mean_error FROM e GROUP BY bits"""


def deinterleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interleaved frame as two channels, sample by sample."""
    f = frames(spark, sf_dir)
    k = F.sequence(F.lit(0), F.floor(F.size("x") / 2).cast("int") - 1)
    both = F.transform(k, lambda j: F.struct(j.cast("bigint").alias("k"), F.get("x", 2 * j).alias("even"), F.get("x", 2 * j + 1).alias("odd")))
    return f.where(F.size("x") > 1).select("frame_no", F.inline(both))


ORACLES["deinterleave"] = f"WITH {FRAMES_SQL} SELECT frame_no, i // 2 AS k, max(CASE WHEN i % 2 = 0 THEN x END) AS even, max(CASE WHEN i % 2 = 1 THEN x END) AS odd FROM f GROUP BY 1, 2"


def downmix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir).select("frame_no", F.posexplode(F.zip_with("l", "r", lambda a, b: (a + b) / 2)).alias("i", "x"))
    return p.select("frame_no", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x"))


ORACLES["downmix"] = f"WITH {PAIRS_SQL} SELECT frame_no, i, round((l + r) / 2, 6) AS x FROM p"


def silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames whose energy is above a millionth of the loudest of their label, and how many there are."""
    f = frames(spark, sf_dir).select("label", S.energy(F.col("x")).alias("e"))
    top = f.groupBy(F.col("label").alias("l")).agg(F.max("e").alias("top"))
    return f.join(top, F.col("label").eqNullSafe(F.col("l"))).groupBy("label").agg(F.count("*").alias("frames"), F.count_if(F.col("e") > 1e-6 * F.col("top")).alias("active"))


ORACLES["silence"] = f"""WITH {FRAMES_SQL}, e AS (SELECT frame_no, label, sum(x * x) AS e FROM f GROUP BY 1, 2), t AS (SELECT label, max(e) AS top FROM e GROUP BY 1)
SELECT e.label, count(*) AS frames, count(*) FILTER (e > 1e-6 * top) AS active FROM e JOIN t ON e.label IS NOT DISTINCT FROM t.label GROUP BY 1"""

QUERIES = {f.__name__: f for f in (levels, dynamics, peak_norm, gain_db, pcm16, pcm16_trunc, wav_scale_roundtrip, deinterleave, downmix, silence)}
