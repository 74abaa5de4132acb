"""Bands, masks, quantisers and distances of frames read as spectra. A band is 8 bins; frames are local to a row, so no
query here but those that sum over frames has an exchange."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavecrest.functions import signal as S
from wavecrest.operators.bridge import FRAMES_SQL, frames, samples
from wavecrest.operators.ranks import quantiles

ORACLES: dict[str, str] = {}
WIDTH, STEP, RATE = 8, 0.02, 16000.0


def bands(x: Column, make, width: int = WIDTH) -> Column:
    """make(band number, its samples) for each band of an array."""
    at = F.when(F.size(x) > 0, F.sequence(F.lit(0), F.ceil(F.size(x) / width).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda b: make(b, F.slice(x, b * width + 1, F.lit(width))))


def band_energies(x: Column) -> Column:
    return bands(x, lambda b, v: S.energy(v))


ENERGY_SQL = FRAMES_SQL + ", e AS (SELECT frame_no, i // 8 AS band, sum(x * x) AS e FROM f GROUP BY 1, 2)"


def band_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = frames(spark, sf_dir).select("frame_no", F.posexplode(band_energies(F.col("x"))).alias("band", "e"))
    return e.select("frame_no", F.col("band").cast("bigint").alias("band"), F.round("e", 6).alias("energy"))


ORACLES["band_energy"] = f"WITH {ENERGY_SQL} SELECT frame_no, band, round(e, 6) AS energy FROM e"


def centre(band: Column) -> Column:
    """Critical-band rate at a band's centre; 64 bins reach half of RATE."""
    return S.bark((band * WIDTH + WIDTH / 2) * (RATE / 2 / 64))


def masks(energies: Column, offset_db: float = 14.0) -> Column:
    """Masking threshold of each band: all bands' energies, spread over critical bands, less an offset. Weights between the first 8 bands are
    constants, others are computed."""
    z = [13 * math.atan(hz * 0.00076) + 3.5 * math.atan((hz / 7500) ** 2) for hz in ((b * WIDTH + WIDTH / 2) * (RATE / 2 / 64) for b in range(8))]
    level = lambda y: 15.81 + 7.5 * y - 17.5 * math.sqrt(1 + y * y)
    known = F.array(*[F.array(*[S.lit(10 ** (level(a - b + 0.474) / 10)) for b in z]) for a in z])
    weight = lambda j, k: F.coalesce(F.get(F.get(known, j), k), F.pow(S.lit(10), S.spread_db(centre(j) - centre(k)) / 10))

    def spread(e: Column) -> Column:
        return F.transform(e, lambda _, j: S.total(F.transform(e, lambda v, k: v * weight(j, k))) * (10 ** (-offset_db / 10)))

    return S.let(energies, spread)


BARK_SQL = "13 * atan({0} * 0.00076) + 3.5 * atan(pow({0} / 7500, 2))"
MASK_SQL = ENERGY_SQL + f""", z AS (SELECT DISTINCT band, {BARK_SQL.format('((band * 8 + 4.0) * 125.0)')} AS z FROM e),
d AS (SELECT j.band AS j, k.band AS k, j.z - k.z + 0.474 AS y FROM z j, z k),
m AS (SELECT a.frame_no, a.band, sum(b.e * pow(10, (15.81 + 7.5 * y - 17.5 * sqrt(1 + y * y)) / 10)) * pow(10, -1.4) AS mask FROM e a JOIN e b USING (frame_no) JOIN d ON d.j = a.band AND d.k = b.band GROUP BY 1, 2)"""


def spread_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = frames(spark, sf_dir).where(F.size("x") > 0).select("frame_no", F.posexplode(masks(band_energies(F.col("x")))).alias("band", "mask"))
    return m.select("frame_no", F.col("band").cast("bigint").alias("band"), F.round("mask", 6).alias("mask"))


ORACLES["spread_mask"] = f"WITH {MASK_SQL} SELECT frame_no, band, round(mask, 6) AS mask FROM m"


def tonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectral flatness (geometric over arithmetic mean of power) of each frame, and tonality, 0 to 1, at -60 dB."""
    power = F.transform("x", lambda v: v * v + S.TINY)
    f = frames(spark, sf_dir).where(F.size("x") > 0).select("frame_no", F.exp(S.total(F.transform(power, lambda p: F.ln(p))) / F.size("x")).alias("g"), (S.total(power) / F.size("x")).alias("a"))
    flat = S.db(F.col("g") / F.col("a"))
    return f.select("frame_no", F.round(flat, 5).alias("flatness_db"), F.round(F.greatest(F.least(flat / -60, S.lit(1)), S.lit(0)), 6).alias("alpha"))


ORACLES["tonality"] = f"""WITH {FRAMES_SQL}, g AS (SELECT frame_no, 10 * log10(exp(avg(ln(x * x + 1e-12))) / avg(x * x + 1e-12)) AS flat FROM f GROUP BY 1)
SELECT frame_no, round(flat, 5) AS flatness_db, round(greatest(least(flat / -60, 1), 0), 6) AS alpha FROM g"""


def noise_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_no, label, bits, nmr: noise to mask in dB of each band of each frame, under quantisers of three depths."""
    f = frames(spark, sf_dir).where(F.size("x") > 0).withColumn("mask", masks(band_energies(F.col("x"))))
    f = f.withColumn("bits", F.explode(F.array(F.lit(6), F.lit(8), F.lit(10))))
    top = F.pow(S.lit(2), F.col("bits") - 1) - 1
    noise = F.transform("x", lambda v: S.half_away(S.clamp(v) * top) / top - v)
    both = F.zip_with(band_energies(noise), "mask", lambda n, m: S.db((n + S.TINY) / (m + S.TINY)))
    return f.select("frame_no", "label", "bits", F.explode(both).alias("nmr"))


def noise_to_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By depth of a quantiser: mean and 95th percentile of noise to mask over all bands of all frames, and the share above the mask."""
    v = noise_ratios(spark, sf_dir)
    g = v.groupBy("bits").agg(F.avg("nmr").alias("mean"), F.avg((F.col("nmr") > 0).cast("int")).alias("above"))
    g = g.join(quantiles(v, "bits", "nmr", 0.95, 0.25, "p95"), "bits")
    return g.select("bits", F.round("mean", 4).alias("nmr_mean"), F.round("p95", 4).alias("nmr_p95"), F.round(100 * F.col("above"), 4).alias("audible_pct"))


ORACLES["noise_to_mask"] = f"""WITH {MASK_SQL}, q AS (SELECT frame_no, i // 8 AS band, bits, sum(pow(sign(x) * floor(abs(greatest(least(x, 1.0), -1.0) * (pow(2, bits - 1) - 1)) + 0.5) / (pow(2, bits - 1) - 1) - x, 2)) AS n FROM f, (VALUES (6), (8), (10)) t(bits) GROUP BY 1, 2, 3),
v AS (SELECT bits, 10 * log10((n + 1e-12) / (mask + 1e-12)) AS nmr FROM q JOIN m USING (frame_no, band))
SELECT CAST(bits AS INTEGER) AS bits, round(avg(nmr), 4) AS nmr_mean, round(quantile_cont(nmr, 0.95), 4) AS nmr_p95, round(100 * avg(CASE WHEN nmr > 0 THEN 1 ELSE 0 END), 4) AS audible_pct FROM v GROUP BY 1"""


def spectral_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroid, share of energy in the upper half, and the first bin by which 95 % of the energy is reached."""
    f = frames(spark, sf_dir).where(F.size("x") > 0).select("frame_no", F.transform("x", lambda v: v * v).alias("p"))
    sums = f.withColumn("all", S.total(F.col("p")))
    start = F.struct(S.lit(0).alias("sum"), F.lit(0).alias("i"), F.lit(-1).alias("hit"))

    def step(a: Column, v: Column) -> Column:
        s = a["sum"] + v
        hit = F.when((a["hit"] < 0) & (F.round(s, 9) >= F.round(0.95 * F.col("all"), 9)), a["i"]).otherwise(a["hit"])
        return F.struct(s.alias("sum"), (a["i"] + 1).alias("i"), hit.alias("hit"))

    roll = F.reduce("p", start, step, lambda a: a["hit"])
    weighted = S.total(F.transform("p", lambda v, i: v * i))
    high = S.total(F.filter("p", lambda v, i: 2 * i >= F.size("p")))
    return sums.select("frame_no", F.round(weighted / (F.col("all") + 1e-30), 5).alias("centroid"), F.round(100 * high / (F.col("all") + 1e-30), 5).alias("high_pct"), roll.cast("bigint").alias("rolloff"))


ORACLES["spectral_shape"] = f"""WITH {FRAMES_SQL}, s AS (SELECT frame_no, i, x * x AS p, sum(x * x) OVER (PARTITION BY frame_no ORDER BY i) AS cum, sum(x * x) OVER (PARTITION BY frame_no) AS al FROM f)
SELECT frame_no, round(sum(p * i) / (max(al) + 1e-30), 5) AS centroid, round(100 * coalesce(sum(p) FILTER (i >= 32), 0) / (max(al) + 1e-30), 5) AS high_pct, min(i) FILTER (round(cum, 9) >= round(0.95 * al, 9)) AS rolloff FROM s GROUP BY 1"""


def power_quant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The power-law quantiser and what comes back from it."""
    s = samples(spark, sf_dir).withColumn("ix", S.power_quantise(F.col("x"), STEP))
    return s.select("frame_no", "i", "ix", F.round(S.power_dequantise(F.col("ix"), STEP), 6).alias("back"))


QUANT_SQL = "CAST(sign(x) * floor(pow(abs(x) / 0.02, 0.75) + 0.4054) AS BIGINT)"
ORACLES["power_quant"] = f"WITH {FRAMES_SQL}, q AS (SELECT frame_no, i, {QUANT_SQL} AS ix FROM f) SELECT frame_no, i, ix, round(sign(ix) * pow(abs(ix), 4 / 3.0) * 0.02, 6) AS back FROM q"


def lowpass_zero(spark: SparkSession, sf_dir: str, keep: int = 40) -> DataFrame:
    f = frames(spark, sf_dir).select("frame_no", F.posexplode(F.transform("x", lambda v, i: F.when(i >= keep, S.lit(0)).otherwise(v))).alias("i", "x"))
    return f.select("frame_no", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x"))


ORACLES["lowpass_zero"] = f"WITH {FRAMES_SQL} SELECT frame_no, i, round(CASE WHEN i >= 40 THEN 0 ELSE x END, 6) AS x FROM f"


def haar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step of Haar's transform: sums and differences of neighbours."""
    k = F.sequence(F.lit(0), F.floor(F.size("x") / 2).cast("int") - 1)
    r = S.lit(math.sqrt(0.5))
    both = F.transform(k, lambda j: F.struct(j.cast("bigint").alias("k"), F.round((F.get("x", 2 * j) + F.get("x", 2 * j + 1)) * r, 6).alias("low"), F.round((F.get("x", 2 * j) - F.get("x", 2 * j + 1)) * r, 6).alias("high")))
    return frames(spark, sf_dir).where(F.size("x") > 1).select("frame_no", F.inline(both))


ORACLES["haar"] = f"WITH {FRAMES_SQL} SELECT a.frame_no, a.i // 2 AS k, round((a.x + b.x) * sqrt(0.5), 6) AS low, round((a.x - b.x) * sqrt(0.5), 6) AS high FROM f a JOIN f b ON b.frame_no = a.frame_no AND b.i = a.i + 1 WHERE a.i % 2 = 0"


def median5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of five, where there are two on either side; else the value itself."""
    n = F.size("x")
    out = F.transform("x", lambda v, i: F.when((i >= 2) & (i + 2 < n), F.get(F.sort_array(F.slice("x", F.greatest(i - 1, F.lit(1)), F.lit(5))), F.lit(2))).otherwise(v))
    f = frames(spark, sf_dir).select("frame_no", F.posexplode(out).alias("i", "x"))
    return f.select("frame_no", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x"))


ORACLES["median5"] = f"""WITH {FRAMES_SQL}, m AS (SELECT frame_no, i, x, median(x) OVER w AS m, count(*) OVER w AS n FROM f WINDOW w AS (PARTITION BY frame_no ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT frame_no, i, round(CASE WHEN n = 5 THEN m ELSE x END, 6) AS x FROM m"""


def cosine_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orthonormal cosine transform of each whole frame, of any length."""
    n = F.size("x")

    def row(k: Column) -> Column:
        norm = F.sqrt(F.when(k == 0, S.lit(1)).otherwise(S.lit(2)) / n)
        return norm * S.total(F.transform("x", lambda v, i: v * F.cos((2 * i + 1) * k * (math.pi / 2) / n)))

    f = frames(spark, sf_dir).where(n > 0).select("frame_no", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), row)).alias("k", "c"))
    return f.select("frame_no", F.col("k").cast("bigint").alias("k"), F.round("c", 6).alias("c"))


ORACLES["cosine_transform"] = f"""WITH {FRAMES_SQL}, s AS (SELECT frame_no, count(*) AS n FROM f GROUP BY 1), k AS (SELECT frame_no, n, unnest(range(0, n)) AS k FROM s)
SELECT frame_no, k, round(sqrt(CASE WHEN k = 0 THEN 1.0 ELSE 2.0 END / n) * sum(x * cos((2 * i + 1) * k * pi() / 2 / n)), 6) AS c FROM f JOIN k USING (frame_no) GROUP BY frame_no, k, n"""


def cosine_blocks(spark: SparkSession, sf_dir: str, size: int = 16) -> DataFrame:
    """The orthonormal cosine transform of every block of a frame; a last block that isn't full is filled up with zeros."""
    def row(v: Column, k: Column) -> Column:
        norm = F.when(k == 0, S.lit(math.sqrt(1 / size))).otherwise(S.lit(math.sqrt(2 / size)))
        return norm * S.total(F.transform(v, lambda x, i: x * F.cos((2 * i + 1) * k * (math.pi / (2 * size)))))

    at = F.sequence(F.lit(0), F.lit(size - 1))
    blocks = frames(spark, sf_dir).select("frame_no", F.posexplode(bands(F.col("x"), lambda b, v: F.transform(at, lambda k: row(v, k)), size)).alias("block", "c"))
    c = blocks.select("frame_no", F.col("block").cast("bigint").alias("block"), F.posexplode("c").alias("k", "c"))
    return c.select("frame_no", "block", F.col("k").cast("bigint").alias("k"), F.round("c", 6).alias("c"))


ORACLES["cosine_blocks"] = f"""WITH {FRAMES_SQL} SELECT frame_no, i // 16 AS block, k, round(CASE WHEN k = 0 THEN sqrt(1 / 16.0) ELSE sqrt(2 / 16.0) END * sum(x * cos((2 * (i % 16) + 1) * k * pi() / 32)), 6) AS c FROM f, range(0, 16) t(k) GROUP BY 1, 2, 3"""


def snr(spark: SparkSession, sf_dir: str, bits: int = 8) -> DataFrame:
    """Ratio of signal to quantiser noise, of the whole frame, and the mean over segments of 8 samples that aren't silent, each
    held to [-10, 50] dB."""
    noise = F.transform("x", lambda v: S.quantise(v, bits) / (2 ** (bits - 1) - 1) - v)
    f = frames(spark, sf_dir).withColumn("n", noise)
    segments = F.filter(F.zip_with(band_energies(F.col("x")), band_energies(F.col("n")), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda s: s.a >= 1e-7)
    clipped = F.transform(segments, lambda s: F.greatest(F.least(S.ratio_db(s.a, s.b), S.lit(50)), S.lit(-10)))
    return f.select("frame_no", F.round(S.ratio_db(S.energy(F.col("x")), S.energy(F.col("n"))), 5).alias("snr_db"), F.round(F.try_divide(S.total(clipped), F.size(clipped)), 5).alias("seg_snr_db"))


NOISE_SQL = "sign(x) * floor(abs(greatest(least(x, 1.0), -1.0) * 127) + 0.5) / 127.0 - x"
ORACLES["snr"] = f"""WITH {FRAMES_SQL}, n AS (SELECT frame_no, i, x, {NOISE_SQL} AS n FROM f), s AS (SELECT frame_no, i // 8 AS band, sum(x * x) AS a, sum(n * n) AS b FROM n GROUP BY 1, 2),
g AS (SELECT frame_no, avg(greatest(least(10 * log10(a / (b + 1e-30) + 1e-12), 50), -10)) FILTER (a >= 1e-7) AS seg, 10 * log10(sum(a) / (sum(b) + 1e-30) + 1e-12) AS snr FROM s GROUP BY 1)
SELECT frame_no, round(snr, 5) AS snr_db, round(seg, 5) AS seg_snr_db FROM g"""


def band_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all frames: ratio of signal to noise of five bands of unequal width, and each band's share of the noise."""
    edges = [0, 4, 10, 20, 36, 64]
    s = samples(spark, sf_dir)
    band = F.lit(None).cast("bigint")
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        band = F.when((F.col("i") >= a) & (F.col("i") < b), F.lit(k).cast("bigint")).otherwise(band)
    n = S.quantise(F.col("x"), 8) / 127 - F.col("x")
    g = s.select(band.alias("band"), (F.col("x") * F.col("x")).alias("a"), (n * n).alias("b")).where("band is not null").groupBy("band").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    g = g.withColumn("noise", F.sum("b").over(Window.partitionBy(F.lit(0))))  # five rows
    return g.select("band", F.round(S.ratio_db(F.col("a"), F.col("b")), 4).alias("snr_db"), F.round(100 * F.col("b") / (F.col("noise") + 1e-30), 4).alias("noise_pct"))


ORACLES["band_snr"] = f"""WITH {FRAMES_SQL}, b AS (SELECT * FROM (VALUES (0, 0, 4), (1, 4, 10), (2, 10, 20), (3, 20, 36), (4, 36, 64)) t(band, lo, hi)),
g AS (SELECT CAST(band AS BIGINT) AS band, sum(x * x) AS a, sum(pow({NOISE_SQL}, 2)) AS b FROM f JOIN b ON i >= lo AND i < hi GROUP BY 1)
SELECT band, round(10 * log10(a / (b + 1e-30) + 1e-12), 4) AS snr_db, round(100 * b / (sum(b) OVER () + 1e-30), 4) AS noise_pct FROM g"""


def spectral_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By label: the mean over frames of the root mean square difference of levels in dB before and after the power-law quantiser."""
    lv = lambda v: S.db(v * v + 1e-6)
    d = F.transform("x", lambda v: F.pow(lv(v) - lv(S.power_dequantise(S.power_quantise(v, STEP), STEP)), S.lit(2)))
    f = frames(spark, sf_dir).where(F.size("x") > 0).select("label", F.sqrt(S.total(d) / F.size("x")).alias("d"))
    return f.groupBy("label").agg(F.round(F.avg("d"), 5).alias("distance_db"))


ORACLES["spectral_distance"] = f"""WITH {FRAMES_SQL}, q AS (SELECT *, {QUANT_SQL} AS ix FROM f), d AS (SELECT frame_no, label, sqrt(avg(pow(10 * log10(x * x + 1e-6) - 10 * log10(pow(sign(ix) * pow(abs(ix), 4 / 3.0) * 0.02, 2) + 1e-6), 2))) AS d FROM q GROUP BY 1, 2)
SELECT label, round(avg(d), 5) AS distance_db FROM d GROUP BY 1"""

QUERIES = {f.__name__: f for f in (band_energy, spread_mask, tonality, noise_to_mask, spectral_shape, power_quant, lowpass_zero, haar, median5, cosine_transform, cosine_blocks, snr, band_snr, spectral_distance)}
