"""Cheapest candidates, rankings and comparisons with a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavecrest.functions import signal as S
from wavecrest.operators.bridge import FRAMES_SQL, frames, samples, table
from wavecrest.operators.ranks import quantiles, sums_below

ORACLES: dict[str, str] = {}
QUANT_SQL = "CAST(sign(x) * floor(pow(abs(x) / {0}, 0.75) + 0.4054) AS BIGINT)"
DEPTHS = (6, 8, 10)


def contenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_no, label, bits, snr of each frame under each depth; within the row."""
    f = frames(spark, sf_dir).withColumn("bits", F.explode(F.array(*map(F.lit, DEPTHS))))
    top = F.pow(S.lit(2), F.col("bits") - 1) - 1
    noise = F.transform("x", lambda v: S.half_away(S.clamp(v) * top) / top - v)
    return f.select("frame_no", "label", "bits", S.energy(F.col("x")).alias("a"), S.energy(noise).alias("b")).withColumn("snr", S.ratio_db(F.col("a"), F.col("b")))


CONTENDERS_SQL = FRAMES_SQL + """, q AS (SELECT frame_no, label, bits, x, sign(x) * floor(abs(greatest(least(x, 1.0), -1.0) * (pow(2, bits - 1) - 1)) + 0.5) / (pow(2, bits - 1) - 1) - x AS n FROM f, (VALUES (6), (8), (10)) t(bits)),
g AS (SELECT frame_no, label, CAST(bits AS INTEGER) AS bits, sum(x * x) AS a, sum(n * n) AS b FROM q GROUP BY 1, 2, 3), s AS (SELECT *, 10 * log10(a / (b + 1e-30) + 1e-12) AS snr FROM g)"""


def league(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths ranked per frame: silent frames have failed and come last, then by signal-to-noise ratio."""
    c = contenders(spark, sf_dir).withColumn("failed", F.col("a") < 1e-7).withColumn("snr_db", F.round("snr", 5))
    w = Window.partitionBy("frame_no").orderBy("failed", F.desc("snr_db"), "bits")
    return c.select("frame_no", "bits", "snr_db", "failed", F.row_number().over(w).cast("bigint").alias("rank"))


ORACLES["league"] = f"""WITH {CONTENDERS_SQL} SELECT frame_no, bits, round(snr, 5) AS snr_db, a < 1e-7 AS failed, row_number() OVER (PARTITION BY frame_no ORDER BY a < 1e-7, round(snr, 5) DESC, bits) AS rank FROM s"""


def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean ratio by label and depth of odd frames, against even frames as baseline: NEW without one, FAIL if over 0.3 dB below it."""
    c = contenders(spark, sf_dir)
    mean = lambda part, name: c.where(F.pmod("frame_no", F.lit(2)) == part).groupBy("label", "bits").agg(F.round(F.avg("snr"), 5).alias(name))
    base = mean(0, "baseline_db").where("label % 5 <> 0").withColumnsRenamed({"label": "l", "bits": "b"})
    j = mean(1, "snr_db").join(base, (F.col("label") == F.col("l")) & (F.col("bits") == F.col("b")), "left")
    verdict = F.when(F.col("baseline_db").isNull(), "NEW").when(F.col("snr_db") - F.col("baseline_db") < -0.3, "FAIL").otherwise("ok")
    return j.select("label", "bits", "snr_db", "baseline_db", verdict.alias("verdict"))


ORACLES["gate"] = f"""WITH {CONTENDERS_SQL}, n AS (SELECT label, bits, round(avg(snr), 5) AS snr_db FROM s WHERE frame_no % 2 = 1 GROUP BY 1, 2), b AS (SELECT label, bits, round(avg(snr), 5) AS baseline_db FROM s WHERE frame_no % 2 = 0 AND label % 5 <> 0 GROUP BY 1, 2)
SELECT n.label, n.bits, snr_db, baseline_db, CASE WHEN baseline_db IS NULL THEN 'NEW' WHEN snr_db - baseline_db < -0.3 THEN 'FAIL' ELSE 'ok' END AS verdict FROM n LEFT JOIN b ON n.label = b.label AND n.bits = b.bits"""


def code_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per frame the cheapest of four codes for its quantised bins: unary, a prefix with 2 or with 4 fixed bits, or the size class by the
    frame's maximum; of equal ones the first."""
    q = frames(spark, sf_dir).where(F.size("x") > 0).select("frame_no", F.transform("x", lambda v: F.abs(S.power_quantise(v, 0.02))).alias("q"))
    add = lambda cost: F.reduce("q", F.lit(0).cast("bigint"), lambda a, v: a + cost(v))
    sign = lambda v: (v > 0).cast("int")
    top = F.array_max("q")
    width = F.when(top > 0, F.floor(F.log2(top.cast("double") + 1e-9)) + 1).otherwise(0)
    costs = [add(lambda v: v + 1 + sign(v)), add(lambda v: F.shiftright(v, 2) + 3 + sign(v)), add(lambda v: F.shiftright(v, 4) + 5 + sign(v)), add(lambda v: sign(v)) + F.size("q") * width]
    best = F.array_min(F.array(*[F.struct(c.cast("bigint").alias("bits"), F.lit(k).cast("bigint").alias("code")) for k, c in enumerate(costs)]))
    return q.select("frame_no", best.alias("b")).select("frame_no", F.col("b.code").alias("code"), F.col("b.bits").alias("bits"))


ORACLES["code_cost"] = f"""WITH {FRAMES_SQL}, q AS (SELECT frame_no, abs({QUANT_SQL.format('0.02')}) AS q FROM f), g AS (SELECT frame_no, sum(q + 1 + CAST(q > 0 AS INT)) AS c0, sum((q >> 2) + 3 + CAST(q > 0 AS INT)) AS c1, sum((q >> 4) + 5 + CAST(q > 0 AS INT)) AS c2,
sum(CAST(q > 0 AS INT)) + count(*) * CASE WHEN max(q) > 0 THEN CAST(floor(log2(max(q) + 1e-9)) + 1 AS BIGINT) ELSE 0 END AS c3 FROM q GROUP BY 1), u AS (SELECT frame_no, CAST(0 AS BIGINT) AS code, c0 AS b FROM g UNION ALL SELECT frame_no, 1, c1 FROM g UNION ALL SELECT frame_no, 2, c2 FROM g UNION ALL SELECT frame_no, 3, c3 FROM g)
SELECT frame_no, code, CAST(b AS BIGINT) AS bits FROM u QUALIFY row_number() OVER (PARTITION BY frame_no ORDER BY b, code) = 1"""


def factor_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quantiser step, of six around 0.02, with the least error; of equal ones the first."""
    def error(k: int):
        step = 0.02 * (0.97 + 0.015 * k)
        return F.round(S.energy(F.transform("x", lambda v: S.power_dequantise(S.power_quantise(v, step), step) - v)), 9)

    best = F.array_min(F.array(*[F.struct(error(k).alias("e"), F.lit(k).cast("bigint").alias("k")) for k in range(6)]))
    return frames(spark, sf_dir).select("frame_no", best.alias("b")).select("frame_no", F.col("b.k").alias("factor"), F.round("b.e", 6).alias("error"))


ORACLES["factor_search"] = f"""WITH {FRAMES_SQL}, t AS (SELECT k, 0.02 * (0.97 + 0.015 * k) AS st FROM range(0, 6) r(k)), q AS (SELECT frame_no, k, st, x, {QUANT_SQL.format('st')} AS ix FROM f, t),
e AS (SELECT frame_no, k, round(sum(pow(sign(ix) * pow(abs(ix), 4 / 3.0) * st - x, 2)), 9) AS e FROM q GROUP BY 1, 2)
SELECT frame_no, k AS factor, round(e, 6) AS error FROM e QUALIFY row_number() OVER (PARTITION BY frame_no ORDER BY e, k) = 1"""


def gain_search(spark: SparkSession, sf_dir: str, budget: int = 160) -> DataFrame:
    """The finest of 16 steps, each 2^(1/4) of the one before, whose unary code fits a budget of bits; null if none does."""
    def bits(k: int):
        return F.reduce(F.transform("x", lambda v: F.abs(S.power_quantise(v, 0.01 * 2 ** (k / 4)))), F.lit(0).cast("bigint"), lambda a, q: a + q + 1 + (q > 0).cast("int"))

    fits = F.array(*[F.when(bits(k) <= budget, F.lit(k).cast("bigint")) for k in range(16)])
    return frames(spark, sf_dir).select("frame_no", F.array_min(fits).alias("gain"))


ORACLES["gain_search"] = f"""WITH {FRAMES_SQL}, q AS (SELECT frame_no, k, abs({QUANT_SQL.format('(0.01 * pow(2, k / 4.0))')}) AS q FROM f, range(0, 16) r(k)), b AS (SELECT frame_no, k, sum(q + 1 + CAST(q > 0 AS INT)) AS b FROM q GROUP BY 1, 2)
SELECT frame_no, min(k) FILTER (b <= 160) AS gain FROM b GROUP BY 1"""


def last_nonzero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last bin that isn't quantised to zero, and the last above one; -1 if there is none."""
    q = samples(spark, sf_dir).withColumn("q", F.abs(S.power_quantise(F.col("x"), 0.1)))
    return q.groupBy("frame_no").agg(F.coalesce(F.max(F.when(F.col("q") > 0, F.col("i"))), F.lit(-1)).alias("last_nonzero"), F.coalesce(F.max(F.when(F.col("q") > 1, F.col("i"))), F.lit(-1)).alias("last_big"))


ORACLES["last_nonzero"] = f"WITH {FRAMES_SQL}, q AS (SELECT frame_no, i, abs({QUANT_SQL.format('0.1')}) AS q FROM f) SELECT frame_no, coalesce(max(i) FILTER (q > 0), -1) AS last_nonzero, coalesce(max(i) FILTER (q > 1), -1) AS last_big FROM q GROUP BY 1"


def nearest_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as kilohertz over ten, each to the nearest legal rate; of two as near the lower. By rate: how many, and how far off."""
    rates = [8000, 11025, 12000, 16000, 22050, 24000, 32000, 44100, 48000]
    hz = F.round(F.col("value") * 100).cast("bigint")
    near = F.array_min(F.array(*[F.struct(F.abs(hz - r).alias("d"), F.lit(r).cast("bigint").alias("rate")) for r in rates]))
    e = table(spark, sf_dir, "events").select(near.alias("n"))
    return e.groupBy(F.col("n.rate").alias("rate")).agg(F.count("*").alias("n"), F.max("n.d").alias("furthest"))


ORACLES["nearest_rate"] = """WITH e AS (SELECT event_id, CAST(round(value * 100) AS BIGINT) AS hz FROM events), r AS (SELECT * FROM (VALUES (8000), (11025), (12000), (16000), (22050), (24000), (32000), (44100), (48000)) t(rate)),
n AS (SELECT event_id, CAST(rate AS BIGINT) AS rate, abs(hz - rate) AS d FROM e, r QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(hz - rate), rate) = 1) SELECT rate, count(*) AS n, max(d) AS furthest FROM n GROUP BY 1"""


def first_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest of the legal frame sizes that holds a text of a conversation, by size: how many turns, null where none does."""
    rates = [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
    n = F.octet_length("text")
    size = F.lit(None).cast("bigint")
    for r in reversed(rates):
        size = F.when(n <= 144 * r // 44, F.lit(144 * r // 44).cast("bigint")).otherwise(size)
    return table(spark, sf_dir, "conversations").groupBy(size.alias("frame_bytes")).agg(F.count("*").alias("turns"))


ORACLES["first_fit"] = """WITH s AS (SELECT 144 * r // 44 AS b FROM (VALUES (32), (40), (48), (56), (64), (80), (96), (112), (128), (160), (192), (224), (256), (320)) t(r)), n AS (SELECT conv_id, turn, octet_length(encode(text)) AS n FROM conversations)
SELECT CAST((SELECT min(b) FROM s WHERE b >= n) AS BIGINT) AS frame_bytes, count(*) AS turns FROM n GROUP BY 1"""


def bench_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, sample deviation (0 of one), extremes, median and count of event values by type."""
    e = table(spark, sf_dir, "events")
    g = e.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("value").alias("n"))
    mid = quantiles(e, "event_type", "value", 0.5, 1.0, "mid").withColumnRenamed("event_type", "kind")
    return g.join(mid, F.col("event_type").eqNullSafe(F.col("kind")), "left").select("event_type", F.round("m", 6).alias("mean"), F.round(F.coalesce("sd", S.lit(0)), 6).alias("std"), "least", "most", F.round("mid", 6).alias("median"), "n")


ORACLES["bench_stats"] = "SELECT event_type, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, min(value) AS least, max(value) AS most, round(median(value), 6) AS median, count(value) AS n FROM events GROUP BY 1"


def rank_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mann-Whitney's U between the values of each type of event and the first type, ties at their mean rank. Values are counted by type first;
    how many values of the first type are smaller is a running sum over ranges of values, then within a range."""
    e = table(spark, sf_dir, "events").where("value is not null and event_type is not null")
    base = F.col("event_type") == e.select(F.min("event_type")).scalar()
    counted = e.groupBy("event_type", "value").agg(F.count("*").alias("n")).withColumn("is_base", base)
    firsts = counted.groupBy("value").agg(F.sum(F.when(F.col("is_base"), F.col("n")).otherwise(0)).alias("b"))
    below = sums_below(firsts, "value", "b", 1.0, "below")
    u = counted.where("not is_base").join(below, "value").groupBy(F.col("event_type").alias("kind")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("below") + F.col("b") / 2)).alias("u"))
    n_base = counted.where("is_base").select(F.sum("n")).scalar()
    return u.select("kind", "n", n_base.alias("n_base"), F.round("u", 1).alias("u"))


ORACLES["rank_sum"] = """WITH b AS (SELECT min(event_type) AS base FROM events WHERE value IS NOT NULL), p AS (SELECT k.kind, value, event_type = k.kind AS mine FROM events, b, (SELECT DISTINCT event_type AS kind FROM events, b WHERE event_type <> base) k WHERE event_type IN (k.kind, b.base) AND value IS NOT NULL),
r AS (SELECT kind, mine, rank() OVER (PARTITION BY kind ORDER BY value) + (count(*) OVER (PARTITION BY kind, value) - 1) / 2.0 AS r FROM p)
SELECT kind, count(*) FILTER (mine) AS n, count(*) FILTER (NOT mine) AS n_base, round(sum(r) FILTER (mine) - count(*) FILTER (mine) * (count(*) FILTER (mine) + 1) / 2.0, 1) AS u FROM r GROUP BY 1"""


def byte_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in which the text of each turn of a conversation, in UTF-8, differs from the turn before; what one has beyond the other counts."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = c.withColumn("b", before).where("b is not null").select("conv_id", "turn", F.col("text").cast("binary").alias("x"), F.col("b").cast("binary").alias("y"))
    n = F.least(F.octet_length("x"), F.octet_length("y"))
    one = lambda a, i: F.substring(a, i, F.lit(1))
    same = F.when(n > 0, F.reduce(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + (one(F.col("x"), i) == one(F.col("y"), i)).cast("int"))).otherwise(0)
    return c.select("conv_id", "turn", (F.greatest(F.octet_length("x"), F.octet_length("y")) - same).cast("bigint").alias("different"))


ORACLES["byte_diff"] = """WITH c AS (SELECT conv_id, turn, hex(encode(text)) AS x, hex(encode(lag(text) OVER (PARTITION BY conv_id ORDER BY turn))) AS y FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, CAST(greatest(length(x), length(y)) // 2 - coalesce(list_sum(list_transform(range(0, least(length(x), length(y)) // 2), lambda k: CASE WHEN substr(x, 2 * k + 1, 2) = substr(y, 2 * k + 1, 2) THEN 1 ELSE 0 END)), 0) AS BIGINT) AS different FROM c WHERE y IS NOT NULL"""

QUERIES = {f.__name__: f for f in (league, gate, code_cost, factor_search, gain_search, last_nonzero, nearest_rate, first_fit, bench_stats, rank_sum, byte_diff)}
