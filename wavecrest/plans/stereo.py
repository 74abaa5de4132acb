"""Pairs of channels: sums and differences, predictions of one from the other, and when to use which."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrest.functions import signal as S
from wavecrest.operators.bridge import PAIRS_SQL, pairs

ORACLES: dict[str, str] = {}


def by_sample(p: DataFrame, make) -> DataFrame:
    """frame_no, i and the fields of make(l, r) for each sample, computed within the row."""
    return p.select("frame_no", F.posexplode(F.zip_with("l", "r", make)).alias("i", "s")).select("frame_no", F.col("i").cast("bigint").alias("i"), "s.*")


def ms_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_sample(pairs(spark, sf_dir), lambda a, b: F.struct(F.round((a + b) / 2, 6).alias("m"), F.round((a - b) / 2, 6).alias("s")))


ORACLES["ms_forward"] = f"WITH {PAIRS_SQL} SELECT frame_no, i, round((l + r) / 2, 6) AS m, round((l - r) / 2, 6) AS s FROM p"


def ms_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    def back(a: Column, b: Column) -> Column:
        m, s = (a + b) / 2, (a - b) / 2
        return F.struct(F.round(m + s, 6).alias("l"), F.round(m - s, 6).alias("r"))

    return by_sample(pairs(spark, sf_dir), back)


ORACLES["ms_inverse"] = f"WITH {PAIRS_SQL} SELECT frame_no, i, round(l, 6) AS l, round(r, 6) AS r FROM p"


def band_sums(p: DataFrame, width: int, **fields) -> DataFrame:
    """frame_no, band, and for each field the sum over the band of field(l, r); within the row."""
    bands = F.sequence(F.lit(0), F.ceil(F.size("l") / width).cast("int") - 1)

    def one(b: Column) -> Column:
        l, r = (F.slice(c, b * width + 1, F.lit(width)) for c in ("l", "r"))
        return F.struct(b.cast("bigint").alias("band"), *(S.total(F.zip_with(l, r, f)).alias(k) for k, f in fields.items()))

    return p.select("frame_no", F.inline(F.transform(bands, one)))


def ms_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per band of 8: whether middle and side cost less than left and right, (t + eM)(t + eS) < (t + eL)(t + eR), with
    the lesser band energy over 100 as t."""
    e = band_sums(pairs(spark, sf_dir), 8, el=lambda a, b: a * a, er=lambda a, b: b * b, em=lambda a, b: (a + b) * (a + b) / 4, es=lambda a, b: (a - b) * (a - b) / 4)
    t = F.least("el", "er") / 100
    use = (t + F.col("em")) * (t + F.col("es")) < (t + F.col("el")) * (t + F.col("er"))
    return e.select("frame_no", "band", use.alias("use_ms"))


ORACLES["ms_decision"] = f"""WITH {PAIRS_SQL}, e AS (SELECT frame_no, i // 8 AS band, sum(l * l) AS el, sum(r * r) AS er, sum((l + r) * (l + r) / 4) AS em, sum((l - r) * (l - r) / 4) AS es FROM p GROUP BY 1, 2)
SELECT frame_no, band, (least(el, er) / 100 + em) * (least(el, er) / 100 + es) < (least(el, er) / 100 + el) * (least(el, er) / 100 + er) AS use_ms FROM e"""


def integer_stereo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16-bit left/side, side/right and middle/side, each undone: left and right come back exactly."""

    def make(a: Column, b: Column) -> Column:
        l, r = S.quantise(a, 16), S.quantise(b, 16)
        side, mid = l - r, F.shiftright(l + r, 1)
        # the middle lost the low bit of the sum, which is that of the side
        full = F.shiftleft(mid, 1).bitwiseOR(side.bitwiseAND(F.lit(1)))
        return F.struct(side.alias("side"), mid.alias("mid"), (l - side).alias("right_of_left_side"), (side + r).alias("left_of_side_right"), F.shiftright(full + side, 1).alias("left_of_mid_side"), F.shiftright(full - side, 1).alias("right_of_mid_side"))

    return by_sample(pairs(spark, sf_dir), make)


ORACLES["integer_stereo"] = f"""WITH {PAIRS_SQL}, q AS (SELECT frame_no, i, CAST(sign(l) * floor(abs(greatest(least(l, 1.0), -1.0) * 32767) + 0.5) AS BIGINT) AS l, CAST(sign(r) * floor(abs(greatest(least(r, 1.0), -1.0) * 32767) + 0.5) AS BIGINT) AS r FROM p)
SELECT frame_no, i, l - r AS side, (l + r) >> 1 AS mid, r AS right_of_left_side, l AS left_of_side_right, l AS left_of_mid_side, r AS right_of_mid_side FROM q"""


def square_polar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse coupling of magnitude and angle, four cases by their signs."""

    def make(m: Column, a: Column) -> Column:
        first = F.when((m > 0) & (a <= 0), m + a).when((m <= 0) & (a <= 0), m - a).otherwise(m)
        second = F.when((m > 0) & (a > 0), m - a).when((m <= 0) & (a > 0), m + a).otherwise(m)
        return F.struct(F.round(first, 6).alias("first"), F.round(second, 6).alias("second"))

    return by_sample(pairs(spark, sf_dir), make)


ORACLES["square_polar"] = f"""WITH {PAIRS_SQL} SELECT frame_no, i, round(CASE WHEN l > 0 AND r <= 0 THEN l + r WHEN l <= 0 AND r <= 0 THEN l - r ELSE l END, 6) AS first,
round(CASE WHEN l > 0 AND r > 0 THEN l - r WHEN l <= 0 AND r > 0 THEN l + r ELSE l END, 6) AS second FROM p"""


def intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right from left by band: the position that fits best, p = round(4 log2(eR / eL) / 2), in [-30, 30], and what 2^(p / 4) leaves
    of the right band's energy."""
    e = band_sums(pairs(spark, sf_dir), 8, el=lambda a, b: a * a, er=lambda a, b: b * b)
    p = S.half_away(F.greatest(F.least(2 * F.log2((F.col("er") + 1e-12) / (F.col("el") + 1e-12)), S.lit(30)), S.lit(-30)))
    e = e.withColumn("position", p.cast("bigint"))
    return e.select("frame_no", "band", "position", F.round(F.col("er") - F.col("el") * F.pow(S.lit(2), F.col("position") / 2), 6).alias("energy_gap"))


ORACLES["intensity"] = f"""WITH {PAIRS_SQL}, e AS (SELECT frame_no, i // 8 AS band, sum(l * l) AS el, sum(r * r) AS er FROM p GROUP BY 1, 2),
q AS (SELECT *, greatest(least(2 * log2((er + 1e-12) / (el + 1e-12)), 30), -30) AS v FROM e), z AS (SELECT *, CAST(sign(v) * floor(abs(v) + 0.5) AS BIGINT) AS position FROM q)
SELECT frame_no, band, position, round(er - el * pow(2, position / 2.0), 6) AS energy_gap FROM z"""


def best_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gain of left that comes nearest to right, their correlation, and the ratio of signal to what is left over."""
    sums = pairs(spark, sf_dir).select("frame_no", S.total(F.zip_with("l", "r", lambda a, b: a * b)).alias("ab"), S.energy(F.col("l")).alias("aa"), S.energy(F.col("r")).alias("bb"))
    k = F.col("ab") / (F.col("aa") + 1e-30)
    rest = F.greatest(F.col("bb") - k * F.col("ab"), S.lit(0))
    return sums.select("frame_no", F.round(k, 6).alias("scale"), F.round(F.col("ab") / F.sqrt(F.col("aa") * F.col("bb") + 1e-30), 6).alias("correlation"), F.round(S.ratio_db(F.col("bb"), rest), 4).alias("snr_db"))


ORACLES["best_scale"] = f"""WITH {PAIRS_SQL}, s AS (SELECT frame_no, sum(l * r) AS ab, sum(l * l) AS aa, sum(r * r) AS bb FROM p GROUP BY 1)
SELECT frame_no, round(ab / (aa + 1e-30), 6) AS scale, round(ab / sqrt(aa * bb + 1e-30), 6) AS correlation, round(10 * log10(bb / (greatest(bb - ab / (aa + 1e-30) * ab, 0) + 1e-30) + 1e-12), 4) AS snr_db FROM s"""


def best_lag(spark: SparkSession, sf_dir: str, reach: int = 8) -> DataFrame:
    """The shift of right against left with the greatest dot product; of equal ones the lowest."""
    def dot(lag: Column) -> Column:
        at = F.sequence(F.lit(0), F.size("l") - 1)
        return S.total(F.transform(at, lambda i: F.get("l", i) * F.coalesce(F.get("r", F.when(i + lag >= 0, i + lag)), S.lit(0))))

    lags = F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda k: F.struct(F.round(-dot(k), 9).alias("d"), k.alias("lag")))
    return pairs(spark, sf_dir).where(F.size("l") > 0).select("frame_no", F.array_min(lags).alias("b")).select("frame_no", F.col("b.lag").cast("bigint").alias("lag"), F.round(-F.col("b.d"), 6).alias("dot"))


ORACLES["best_lag"] = f"""WITH {PAIRS_SQL}, g AS (SELECT a.frame_no, k AS lag, round(-sum(a.l * coalesce(b.r, 0)), 9) AS d FROM p a CROSS JOIN range(-8, 9) t(k) LEFT JOIN p b ON b.frame_no = a.frame_no AND b.i = a.i + k GROUP BY 1, 2)
SELECT frame_no, lag, round(-d, 6) AS dot FROM g QUALIFY row_number() OVER (PARTITION BY frame_no ORDER BY d, lag) = 1"""

QUERIES = {f.__name__: f for f in (ms_forward, ms_inverse, ms_decision, integer_stereo, square_polar, intensity, best_scale, best_lag)}
