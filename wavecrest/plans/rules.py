"""Rankings and gates by noise to mask, transients, the Kaiser resampler, configurations and other rules with fixed values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavecrest.functions import signal as S
from wavecrest.operators.bridge import CHANNELS_SQL, FRAMES_SQL, channels, frames, table
from wavecrest.plans.search import contenders
from wavecrest.plans.sequence import by_phases, sinc
from wavecrest.plans.spectrum import BARK_SQL, noise_ratios

ORACLES: dict[str, str] = {}

# Legal bitrates in kbit/s and sample rates in Hz of MPEG audio layer III, by version.
RATES_1 = [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
RATES_2 = [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]
HERTZ_1 = [32000, 44100, 48000]
HERTZ_2 = [8000, 11025, 12000, 16000, 22050, 24000]
# Least bits a second and channel, and the cutoff in Hz from there on; below the last, three eighths of the bits.
CUTOFFS = [(96000, 20000.0), (64000, 16000.0), (48000, 14000.0), (32000, 12000.0)]
# A regression is a loss of over 0.3 dB, noise to mask up by over 0.5 dB, or over 1 point more above the mask.
TOLERANCE_SNR, TOLERANCE_NMR, TOLERANCE_AUDIBLE = 0.3, 0.5, 1.0


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_no, label, bits, snr, nmr (mean over bands) and audible (percent of bands above the mask) of each frame and depth; silent frames have
    failed and measure null. One exchange, by frame."""
    n = noise_ratios(spark, sf_dir).groupBy(F.col("frame_no").alias("no"), F.col("bits").alias("depth"))
    n = n.agg(F.avg("nmr").alias("nmr"), (100 * F.avg((F.col("nmr") > 0).cast("int"))).alias("audible"))
    c = contenders(spark, sf_dir)
    sound = lambda x: F.when(F.col("a") >= 1e-7, F.col(x))
    j = c.join(n, (F.col("frame_no") == F.col("no")) & (F.col("bits") == F.col("depth")))
    return j.select("frame_no", "label", "bits", *(sound(x).alias(x) for x in ("snr", "nmr", "audible")))


MEASURED_SQL = f"""{FRAMES_SQL}, no AS (SELECT frame_no, label, bits, i, x, sign(x) * floor(abs(greatest(least(x, 1.0), -1.0) * (pow(2, bits - 1) - 1)) + 0.5) / (pow(2, bits - 1) - 1) - x AS n FROM f, (VALUES (6), (8), (10)) t(bits)),
ba AS (SELECT frame_no, label, CAST(bits AS INTEGER) AS bits, i // 8 AS band, sum(x * x) AS e, sum(n * n) AS n, {BARK_SQL.format('((i // 8 * 8 + 4.0) * 125.0)')} AS z FROM no GROUP BY 1, 2, 3, 4),
ma AS (SELECT o.frame_no, o.bits, o.band, sum(u.e * pow(10, (15.81 + 7.5 * (o.z - u.z + 0.474) - 17.5 * sqrt(1 + pow(o.z - u.z + 0.474, 2))) / 10)) * pow(10, -1.4) AS mask FROM ba o JOIN ba u ON u.frame_no = o.frame_no AND u.bits = o.bits GROUP BY 1, 2, 3),
al AS (SELECT ba.frame_no, label, ba.bits, sum(e) AS e, 10 * log10(sum(e) / (sum(n) + 1e-30) + 1e-12) AS snr, avg(10 * log10((n + 1e-12) / (mask + 1e-12))) AS nmr, 100 * avg(CASE WHEN n > mask THEN 1 ELSE 0 END) AS audible
FROM ba JOIN ma ON ma.frame_no = ba.frame_no AND ma.bits = ba.bits AND ma.band = ba.band GROUP BY 1, 2, 3),
me AS (SELECT frame_no, label, bits, CASE WHEN e >= 1e-7 THEN snr END AS snr, CASE WHEN e >= 1e-7 THEN nmr END AS nmr, CASE WHEN e >= 1e-7 THEN audible END AS audible FROM al)"""


def league_by_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths ranked per frame: those that failed come last, then by noise to mask, least first."""
    m = measured(spark, sf_dir).withColumn("nmr_db", F.round("nmr", 5))
    w = Window.partitionBy("frame_no").orderBy(F.col("nmr_db").isNull(), "nmr_db", "bits")
    return m.select("frame_no", "bits", "nmr_db", F.round("snr", 5).alias("snr_db"), F.row_number().over(w).cast("bigint").alias("rank"))


ORACLES["league_by_mask"] = f"WITH {MEASURED_SQL} SELECT frame_no, bits, round(nmr, 5) AS nmr_db, round(snr, 5) AS snr_db, row_number() OVER (PARTITION BY frame_no ORDER BY round(nmr, 5) ASC NULLS LAST, bits) AS rank FROM me"


def halves(spark: SparkSession, sf_dir: str, odd: int) -> DataFrame:
    m = measured(spark, sf_dir).where(F.pmod("frame_no", F.lit(2)) == odd)
    return m.groupBy("label", "bits").agg(*(F.round(F.avg(x), 4).alias(x) for x in ("snr", "nmr", "audible")))


def gate_by_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By label and depth, odd frames against even ones as baseline: NEW without one, FAIL if any of three metrics is beyond its tolerance. The
    baseline passes through JSON, one text per key, as it does between runs."""
    key = F.concat_ws("@", "label", "bits")
    stored = halves(spark, sf_dir, 0).where("label % 5 <> 0").select(key.alias("k"), F.to_json(F.struct("snr", "nmr", "audible")).alias("json"))
    base = stored.select("k", F.from_json("json", "snr double, nmr double, audible double").alias("b"))
    now = halves(spark, sf_dir, 1).where("label is not null").withColumn("key", key).join(base, F.col("key") == F.col("k"), "left")
    d = {x: F.round(F.col(x) - F.col(f"b.{x}"), 4) for x in ("snr", "nmr", "audible")}
    bad = (d["snr"] < -TOLERANCE_SNR) | (d["nmr"] > TOLERANCE_NMR) | (d["audible"] > TOLERANCE_AUDIBLE)
    verdict = F.when(F.col("k").isNull(), "NEW").when(bad, "FAIL").otherwise("ok")
    return now.select("key", "snr", d["snr"].alias("d_snr"), "nmr", d["nmr"].alias("d_nmr"), "audible", d["audible"].alias("d_audible"), verdict.alias("verdict"))


ORACLES["gate_by_metrics"] = f"""WITH {MEASURED_SQL}, h AS (SELECT frame_no % 2 AS odd, label, bits, round(avg(snr), 4) AS snr, round(avg(nmr), 4) AS nmr, round(avg(audible), 4) AS audible FROM me GROUP BY 1, 2, 3),
d AS (SELECT c.label || '@' || c.bits AS key, c.snr, round(c.snr - b.snr, 4) AS d_snr, c.nmr, round(c.nmr - b.nmr, 4) AS d_nmr, c.audible, round(c.audible - b.audible, 4) AS d_audible, b.bits IS NULL AS fresh
FROM h c LEFT JOIN h b ON b.odd = 0 AND b.label % 5 <> 0 AND b.label = c.label AND b.bits = c.bits WHERE c.odd = 1 AND c.label IS NOT NULL)
SELECT key, snr, d_snr, nmr, d_nmr, audible, d_audible, CASE WHEN fresh THEN 'NEW' WHEN d_snr < -0.3 OR d_nmr > 0.5 OR d_audible > 1.0 THEN 'FAIL' ELSE 'ok' END AS verdict FROM d"""


def mask_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search of scale factors lessens: the sum over a frame's bands of noise over mask, by depth."""
    n = noise_ratios(spark, sf_dir).groupBy("frame_no", "bits")
    return n.agg(F.round(F.sum(F.pow(S.lit(10), F.col("nmr") / 10)), 6).alias("cost"))


ORACLES["mask_cost"] = f"""WITH {MEASURED_SQL} SELECT ba.frame_no, ba.bits, round(sum((n + 1e-12) / (mask + 1e-12)), 6) AS cost FROM ba JOIN ma ON ma.frame_no = ba.frame_no AND ma.bits = ba.bits AND ma.band = ba.band GROUP BY 1, 2"""


def transient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energies of first differences of a frame at the scale of 16 bits, in 8 sub-blocks, against a baseline that rises at once and falls slowly
    (0.7 of it and 0.3 of the energy): an attack is the first one over 8 times the baseline and over a million. Its sub-block, or 0."""
    x = F.transform("x", lambda v: S.quantise(v, 16).cast("double"))
    rise = lambda a: F.transform(a, lambda v, i: F.pow(v - F.coalesce(F.get(a, i - 1), S.lit(0)), S.lit(2)))
    width = F.ceil(F.size("x") / 8).cast("int")
    e = S.let(S.let(x, rise), lambda d: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda w: S.total(F.slice(d, w * width + 1, width))))
    start = F.struct(S.lit(0).alias("base"), F.lit(0).alias("w"), F.lit(-1).alias("hit"))

    def step(a: Column, v: Column) -> Column:
        hit = F.when((a["hit"] < 0) & (v > 8 * a["base"]) & (v > 1e6), a["w"]).otherwise(a["hit"])
        base = F.when(a["base"] > v, 0.7 * a["base"] + 0.3 * v).otherwise(v)
        return F.struct(base.alias("base"), (a["w"] + 1).alias("w"), hit.alias("hit"))

    f = frames(spark, sf_dir).where(F.size("x") > 0).select("frame_no", F.reduce(e, start, step).alias("r"))
    return f.select("frame_no", (F.col("r.hit") >= 0).alias("attack"), F.greatest(F.col("r.hit"), F.lit(0)).cast("bigint").alias("position"), F.round("r.base", 0).alias("baseline"))


ORACLES["transient"] = f"""WITH RECURSIVE {FRAMES_SQL}, q AS (SELECT frame_no, i, sign(x) * floor(abs(greatest(least(x, 1.0), -1.0) * 32767) + 0.5) AS v FROM f), n AS (SELECT frame_no, CAST(ceil(count(*) / 8.0) AS BIGINT) AS width FROM f GROUP BY 1),
d AS (SELECT frame_no, i, pow(v - lag(v, 1, 0) OVER (PARTITION BY frame_no ORDER BY i), 2) AS d FROM q), b AS (SELECT frame_no, w, coalesce((SELECT sum(d) FROM d WHERE d.frame_no = n.frame_no AND d.i // n.width = w), 0) AS e FROM n, range(0, 8) t(w)),
s AS (SELECT frame_no, CAST(0 AS BIGINT) AS w, CAST(0 AS DOUBLE) AS base, CAST(-1 AS BIGINT) AS hit FROM n UNION ALL SELECT s.frame_no, s.w + 1, CASE WHEN s.base > e THEN 0.7 * s.base + 0.3 * e ELSE e END, CASE WHEN hit < 0 AND e > 8 * s.base AND e > 1e6 THEN s.w ELSE hit END FROM s JOIN b ON b.frame_no = s.frame_no AND b.w = s.w)
SELECT frame_no, hit >= 0 AS attack, greatest(hit, 0) AS position, round(base, 0) AS baseline FROM s WHERE w = 8"""


def block_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of a channel's blocks of 8 samples: over 6 times the energy of the block before makes a block and the two behind it short; the block before
    a run of short ones is a start, the one behind it a stop, a block between two runs short too."""
    b = channels(spark, sf_dir).groupBy("channel", F.floor(F.col("i") / 8).alias("block")).agg(F.sum(F.col("x") * F.col("x")).alias("e"))
    w = Window.partitionBy("channel").orderBy("block")
    b = b.withColumn("hit", F.coalesce((F.lag("e").over(w) > 0) & (F.col("e") > 6 * F.lag("e").over(w)), F.lit(False)))
    b = b.withColumn("short", F.max("hit").over(w.rowsBetween(-2, 0)))
    after, before = F.coalesce(F.lead("short").over(w), F.lit(False)), F.coalesce(F.lag("short").over(w), F.lit(False))
    kind = F.when(F.col("short") | (after & before), "short").when(after, "start").when(before, "stop").otherwise("long")
    return b.select("channel", "block", "hit", kind.alias("kind"))


ORACLES["block_kinds"] = f"""WITH {CHANNELS_SQL}, b AS (SELECT channel, i // 8 AS block, sum(x * x) AS e FROM c GROUP BY 1, 2), h AS (SELECT channel, block, coalesce(lag(e) OVER w > 0 AND e > 6 * lag(e) OVER w, false) AS hit FROM b WINDOW w AS (PARTITION BY channel ORDER BY block)),
s AS (SELECT h.channel, h.block, h.hit, EXISTS (SELECT 1 FROM h o WHERE o.hit AND o.channel = h.channel AND o.block BETWEEN h.block - 2 AND h.block) AS sh FROM h),
k AS (SELECT *, coalesce(lag(sh) OVER w, false) AS p, coalesce(lead(sh) OVER w, false) AS n FROM s WINDOW w AS (PARTITION BY channel ORDER BY block))
SELECT channel, block, hit, CASE WHEN sh OR (p AND n) THEN 'short' WHEN n THEN 'start' WHEN p THEN 'stop' ELSE 'long' END AS kind FROM k"""


def bessel0(x: float) -> float:
    return sum(((x / 2) ** k / math.factorial(k)) ** 2 for k in range(40))


def kaiser_phases(up: int, down: int, quality: int = 16, beta: float = 8.0) -> list[list[float]]:
    """Weights of a resampler from ``down`` to ``up``, for each phase, brought to a sum of one: a sinc cut off at the lower Nyquist frequency, under a
    Kaiser window of ceil(quality / cutoff) samples on either side."""
    cutoff = min(1.0, up / down)
    half, out = math.ceil(quality / cutoff), []
    for p in range(up):
        fraction = p * down / up % 1
        at = [fraction - j for j in range(1 - half, half + 1)]
        w = [sinc(d * cutoff) * bessel0(beta * math.sqrt(1 - (d / half) ** 2)) / bessel0(beta) if abs(d) < half else 0.0 for d in at]
        out.append([v / sum(w) for v in w])
    return out


def resample_kaiser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames at three times half their rate, and at two thirds of it; beyond the ends the signal is 0, but the weights there count."""
    f = frames(spark, sf_dir).where(F.size("x") > 0)
    out = []
    for up, down in ((3, 2), (2, 3)):
        phases = kaiser_phases(up, down)
        y = by_phases(F.col("x"), phases, down, 1 - len(phases[0]) // 2)
        out.append(f.select("frame_no", F.lit(f"{up}:{down}").alias("ratio"), F.posexplode(y).alias("k", "y")))
    return out[0].unionAll(out[1]).select("frame_no", "ratio", F.col("k").cast("bigint").alias("k"), F.round("y", 6).alias("y"))


ORACLES["resample_kaiser"] = f"""WITH {FRAMES_SQL}, r AS (SELECT * FROM (VALUES ('3:2', 1.5, 16, 1.0), ('2:3', 2 / 3.0, 24, 2 / 3.0)) t(ratio, r, half, cutoff)), n AS (SELECT frame_no, count(*) AS n FROM f GROUP BY 1), sizes AS (SELECT DISTINCT n FROM n),
o AS (SELECT ratio, r, half, cutoff, n, k, k / r AS pos FROM r, sizes, range(0, 1000) t(k) WHERE k < floor(n * r + 0.5)), t AS (SELECT *, CAST(floor(pos + 1e-9) AS BIGINT) + j AS tap, pos - CAST(floor(pos + 1e-9) AS BIGINT) - j AS d FROM o, range(-23, 25) g(j) WHERE j > -half AND j <= half),
s AS (SELECT kk, CAST(factorial(CAST(kk AS INTEGER)) AS DOUBLE) AS fk FROM range(0, 31) z(kk)), w AS (SELECT ratio, n, k, tap, CASE WHEN abs(d) < 1e-9 THEN 1 ELSE sin(pi() * d * cutoff) / (pi() * d * cutoff) END * (SELECT sum(pow(pow(4 * sqrt(greatest(1 - pow(d / half, 2), 0)), kk) / fk, 2)) FROM s) AS w FROM t WHERE abs(d) < half),
a AS (SELECT ratio, n, k, sum(w) AS a FROM w GROUP BY 1, 2, 3)
SELECT frame_no, w.ratio, w.k, round(sum(coalesce(x, 0) * w) / max(a), 6) AS y FROM n JOIN w USING (n) JOIN a ON a.ratio = w.ratio AND a.n = n.n AND a.k = w.k LEFT JOIN f USING (frame_no) WHERE f.i = w.tap GROUP BY 1, 2, 3"""


def configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration for each event: kilobits a second from its value, sample rate by its number, channels and mode by its user."""
    rate = F.get(F.array(*map(F.lit, HERTZ_2 + HERTZ_1 + [96000])), F.pmod("event_id", F.lit(10)).cast("int"))
    kbps = F.floor(F.col("value") / 8).cast("int") * 8
    return table(spark, sf_dir, "events").select("event_id", rate.alias("rate"), kbps.alias("kbps"), F.pmod("user_id", F.lit(4)).cast("int").alias("channels"), F.when(F.col("event_type") < "m", "mono").otherwise("joint").alias("mode"))


def legal_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations by why they are refused: a rate or bitrate that isn't legal (no partner in the table of legal ones), a number of channels that isn't
    1 or 2, a mode that doesn't go with it; or that are accepted."""
    legal = [(r, b) for rates, kbps in ((HERTZ_1, RATES_1), (HERTZ_2, RATES_2)) for r in rates for b in kbps]
    grid = F.broadcast(spark.createDataFrame(legal, "rate int, kbps int"))
    c = configurations(spark, sf_dir)
    fits = F.when(~F.col("channels").isin(1, 2), "channels").when((F.col("channels") == 1) != (F.col("mode") == "mono"), "mode").otherwise("accepted")
    known, unknown = c.join(grid, ["rate", "kbps"], "left_semi"), c.join(grid, ["rate", "kbps"], "left_anti")
    out = known.select(fits.alias("verdict")).unionAll(unknown.select(F.lit("rate").alias("verdict")))
    return out.groupBy("verdict").agg(F.count("*").alias("n"))


ORACLES["legal_config"] = f"""WITH c AS (SELECT list_extract({HERTZ_2 + HERTZ_1 + [96000]}, CAST(event_id % 10 + 1 AS INTEGER)) AS rate, CAST(floor(value / 8) AS INTEGER) * 8 AS kbps, user_id % 4 AS channels, CASE WHEN event_type < 'm' THEN 'mono' ELSE 'joint' END AS mode FROM events)
SELECT CASE WHEN NOT ((list_contains({HERTZ_1}, rate) AND list_contains({RATES_1}, kbps)) OR (list_contains({HERTZ_2}, rate) AND list_contains({RATES_2}, kbps))) THEN 'rate' WHEN channels NOT IN (1, 2) THEN 'channels' WHEN (channels = 1) <> (mode = 'mono') THEN 'mode' ELSE 'accepted' END AS verdict, count(*) AS n FROM c GROUP BY 1"""


def cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bandwidth by bits a second and channel, by steps; event values in hundreds of bits. By bandwidth from the steps, how many events."""
    bits = F.round(F.col("value") * 250).cast("bigint")
    hz = bits * 0.375
    for least, cutoff in reversed(CUTOFFS):
        hz = F.when(bits >= least, S.lit(cutoff)).otherwise(hz)
    e = table(spark, sf_dir, "events").select(hz.alias("hz"), bits.alias("bits"))
    return e.groupBy(F.round("hz", 3).alias("cutoff_hz")).agg(F.count("*").alias("n"), F.min("bits").alias("least_bits"))


ORACLES["cutoffs"] = """WITH e AS (SELECT CAST(round(value * 250) AS BIGINT) AS b FROM events), c AS (SELECT b, CASE WHEN b >= 96000 THEN 20000 WHEN b >= 64000 THEN 16000 WHEN b >= 48000 THEN 14000 WHEN b >= 32000 THEN 12000 ELSE b * 0.375 END AS hz FROM e)
SELECT round(CAST(hz AS DOUBLE), 3) AS cutoff_hz, count(*) AS n, min(b) AS least_bits FROM c GROUP BY 1"""

QUERIES = {f.__name__: f for f in (league_by_mask, gate_by_metrics, mask_cost, transient, block_kinds, resample_kaiser, legal_config, cutoffs)}
