"""Fixed-point arithmetic, checksums, generators, orders and ladders of frames; all within the row unless a window is named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavecrest.functions import signal as S
from wavecrest.operators.bridge import CHANNELS_SQL, FRAMES_SQL, channels, frames, pairs
from wavecrest.plans.sequence import PCM_SQL
from wavecrest.plans.stereo import PAIRS_SQL, by_sample

ORACLES: dict[str, str] = {}
MASK32 = (1 << 32) - 1


def pcm_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("frame_no", F.transform("x", lambda x: S.quantise(x, 16)).alias("v"))


def wrap32(x: Column) -> Column:
    """A whole number folded into the range of a signed 32-bit integer."""
    low = x.bitwiseAND(F.lit(MASK32))
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low)


def saturate(x: Column, bits: int) -> Column:
    return F.greatest(F.least(x, F.lit((1 << (bits - 1)) - 1)), F.lit(-(1 << (bits - 1))))


def fixed_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of 16-bit samples in Q15, sums that saturate at 16 bits, and products that wrap at 32."""

    def make(a: Column, b: Column) -> Column:
        l, r = S.quantise(a, 16), S.quantise(b, 16)
        return F.struct(F.shiftright(l * r, 15).alias("product"), saturate(4 * (l + r), 16).alias("sum"), wrap32(l * 65536 * r).alias("wrapped"))

    return by_sample(pairs(spark, sf_dir), make)


ORACLES["fixed_point"] = f"""WITH {PAIRS_SQL}, q AS (SELECT frame_no, i, CAST(sign(l) * floor(abs(greatest(least(l, 1.0), -1.0) * 32767) + 0.5) AS BIGINT) AS l, CAST(sign(r) * floor(abs(greatest(least(r, 1.0), -1.0) * 32767) + 0.5) AS BIGINT) AS r FROM p),
w AS (SELECT *, ((l * 65536 * r) % 4294967296 + 4294967296) % 4294967296 AS w FROM q)
SELECT frame_no, i, (l * r) >> 15 AS product, greatest(least(4 * (l + r), 32767), -32768) AS sum, CASE WHEN w >= 2147483648 THEN w - 4294967296 ELSE w END AS wrapped FROM w"""


def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a frame's 16-bit samples: exclusive or, and Fowler, Noll and Vo's hash of their low bytes (offset 2166136261, prime 16777619)."""
    start = F.lit(2166136261).cast("bigint")
    fnv = F.reduce("v", start, lambda h, x: (h.bitwiseXOR(x.bitwiseAND(F.lit(255))) * 16777619).bitwiseAND(F.lit(MASK32)))
    xor = F.reduce("v", F.lit(0).cast("bigint"), lambda h, x: h.bitwiseXOR(x))
    return pcm_frames(spark, sf_dir).select("frame_no", xor.alias("xor_all"), fnv.alias("fnv1a"))


ORACLES["checksums"] = f"""WITH {PCM_SQL}, l AS (SELECT frame_no, bit_xor(v) AS xor_all, list(v & 255 ORDER BY i) AS b FROM q GROUP BY 1)
SELECT frame_no, xor_all, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), b), lambda h, x: (xor(h, x) * 16777619) & 4294967295) AS fnv1a FROM l"""


def generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of the linear congruential generator 1664525 s + 1013904223 modulo 2^32 after as many steps as a frame has samples,
    seeded with the frame's number."""
    step = lambda s, _: (s * 1664525 + 1013904223).bitwiseAND(F.lit(MASK32))
    return frames(spark, sf_dir).select("frame_no", F.reduce("x", F.col("frame_no"), step).alias("state"))


ORACLES["generator"] = """SELECT vec_id AS frame_no, list_reduce(list_prepend(vec_id, list_transform(embedding, lambda e: CAST(0 AS BIGINT))), lambda s, x: (s * 1664525 + 1013904223) & 4294967295) AS state FROM embeddings"""


def argsort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of a frame's samples by value, then place."""
    order = F.array_sort(F.transform("x", lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    f = frames(spark, sf_dir).select("frame_no", F.posexplode(order).alias("rank", "s"))
    return f.select("frame_no", F.col("rank").cast("bigint").alias("rank"), F.col("s.i").cast("bigint").alias("i"))


ORACLES["argsort"] = f"WITH {FRAMES_SQL} SELECT frame_no, row_number() OVER (PARTITION BY frame_no ORDER BY x, i) - 1 AS rank, i FROM f"


def spacing_repair(spark: SparkSession, sf_dir: str, gap: float = 0.01) -> DataFrame:
    """A frame's samples in ascending order, each raised to lie a least distance above the one before: the running maximum of
    x - k gap, plus k gap."""
    s = F.sort_array("x")
    up = F.reduce(s, F.array().cast("array<double>"), lambda acc, x: F.concat(acc, F.array(F.greatest(x, F.coalesce(F.get(acc, F.size(acc) - 1) + gap, x)))))
    f = frames(spark, sf_dir).select("frame_no", F.posexplode(up).alias("k", "y"))
    return f.select("frame_no", F.col("k").cast("bigint").alias("k"), F.round("y", 6).alias("y"))


ORACLES["spacing_repair"] = f"""WITH {FRAMES_SQL}, s AS (SELECT frame_no, row_number() OVER (PARTITION BY frame_no ORDER BY x, i) - 1 AS k, x FROM f)
SELECT frame_no, k, round(max(x - k * 0.01) OVER (PARTITION BY frame_no ORDER BY k) + k * 0.01, 6) AS y FROM s"""


def slope_ladder(spark: SparkSession, sf_dir: str, slope: float = 0.02) -> DataFrame:
    """The lowest line above a frame's sizes that falls by no more than a slope to either side."""
    size = F.transform("x", lambda v: F.abs(v))
    at = F.sequence(F.lit(0), F.size("x") - 1)
    f = frames(spark, sf_dir).where(F.size("x") > 0).withColumn("a", size)
    top = F.transform(at, lambda i: F.array_max(F.transform("a", lambda v, j: v - slope * F.abs(i - j))))
    f = f.select("frame_no", F.posexplode(top).alias("i", "y"))
    return f.select("frame_no", F.col("i").cast("bigint").alias("i"), F.round("y", 6).alias("y"))


ORACLES["slope_ladder"] = f"""WITH {FRAMES_SQL} SELECT frame_no, i, round(greatest(max(abs(x) + i * 0.02) OVER (PARTITION BY frame_no ORDER BY i) - i * 0.02, max(abs(x) - i * 0.02) OVER (PARTITION BY frame_no ORDER BY i DESC) + i * 0.02), 6) AS y FROM f"""


def top_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two lags, 2 to 20, with the greatest squared correlation over energy; of equal ones the lower."""

    def score(lag: Column) -> Column:
        dot = S.total(F.transform("x", lambda v, i: v * F.coalesce(F.get("x", i + lag), S.lit(0))))
        power = S.total(F.transform("x", lambda v, i: F.when(i >= lag, v * v).otherwise(S.lit(0))))
        return F.round(-F.when(dot > 0, dot * dot).otherwise(S.lit(0)) / (power + S.TINY), 9)

    ranked = F.slice(F.array_sort(F.transform(F.sequence(F.lit(2), F.lit(20)), lambda k: F.struct(score(k).alias("s"), k.alias("lag")))), 1, 2)
    f = frames(spark, sf_dir).select("frame_no", F.posexplode(ranked).alias("rank", "b"))
    return f.select("frame_no", F.col("rank").cast("bigint").alias("rank"), F.col("b.lag").cast("bigint").alias("lag"), F.round(-F.col("b.s"), 6).alias("score"))


ORACLES["top_lags"] = f"""WITH {FRAMES_SQL}, d AS (SELECT a.frame_no, k AS lag, coalesce(sum(a.x * b.x), 0) AS dot, coalesce(sum(b.x * b.x), 0) AS power FROM f a CROSS JOIN range(2, 21) t(k) LEFT JOIN f b ON b.frame_no = a.frame_no AND b.i = a.i + k GROUP BY 1, 2),
s AS (SELECT frame_no, lag, round(-CASE WHEN dot > 0 THEN dot * dot ELSE 0 END / (power + 1e-12), 9) AS s FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY frame_no ORDER BY s, lag) - 1 AS rank FROM s)
SELECT frame_no, rank, lag, round(-s, 6) AS score FROM r WHERE rank < 2"""


def sum_in_order(order: str, value: str) -> Column:
    """The sum of a few rows of a group, added in an order that doesn't hang on how they are dealt out; null if all are."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.col(value).alias("v"))))
    return F.reduce(items, F.lit(None).cast("double"), lambda a, x: F.coalesce(a + x["v"], x["v"], a))


def seek_table(spark: SparkSession, sf_dir: str, parts: int = 10) -> DataFrame:
    """A table of contents of each channel: for every tenth part of its blocks, 256ths of its bytes before that block. A block of up
    to 8 samples takes 20 bytes and one more for each whole hundred of its sum, which is added up in order of time: another order can end on the other side
    of a hundred."""
    b = channels(spark, sf_dir).groupBy("channel", F.floor(F.col("i") / 8).alias("block")).agg((20 + F.floor(sum_in_order("i", "x") / 100)).alias("bytes"))
    w = Window.partitionBy("channel")
    b = b.withColumns({"before": F.sum("bytes").over(w.orderBy("block")) - F.col("bytes"), "all": F.sum("bytes").over(w), "n": F.count("*").over(w)})
    at = b.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).where(F.floor(F.col("p") * F.col("n") / parts) == F.col("block"))
    return at.select("channel", F.col("p").cast("bigint").alias("part"), F.least(F.floor(F.col("before") * 256 / F.col("all")), F.lit(255)).alias("entry"))


ORACLES["seek_table"] = f"""WITH {CHANNELS_SQL}, b AS (SELECT channel, i // 8 AS block, CAST(20 + floor(sum(x) / 100) AS BIGINT) AS bytes FROM c GROUP BY 1, 2),
s AS (SELECT *, sum(bytes) OVER (PARTITION BY channel ORDER BY block) - bytes AS before, sum(bytes) OVER (PARTITION BY channel) AS al, count(*) OVER (PARTITION BY channel) AS n FROM b)
SELECT channel, p AS part, CAST(least(before * 256 // al, 255) AS BIGINT) AS entry FROM s, range(0, 10) t(p) WHERE (p * n) // 10 = block"""


def seek_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``seek_table`` gives, for every hundredth part."""
    return seek_table(spark, sf_dir, 100)


ORACLES["seek_points"] = ORACLES["seek_table"].replace("range(0, 10)", "range(0, 100)").replace("(p * n) // 10 ", "(p * n) // 100 ")


def i0(x: Column) -> Column:
    """The modified Bessel function of order 0, from 25 terms of its series."""
    start = F.struct(S.lit(1).alias("term"), S.lit(1).alias("sum"))

    def add(a: Column, k: Column) -> Column:
        term = a["term"] * F.pow(x / (2 * k), S.lit(2))
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    return F.reduce(F.sequence(F.lit(1), F.lit(25)), start, add, lambda a: a["sum"])


def bessel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modified Bessel function of order 0 of 8 times a frame's greatest |x|, from 25 terms of its series, and the Kaiser weight that follows from it."""
    peak = F.array_max(F.transform("x", lambda v: F.abs(S.clamp(v))))
    f = frames(spark, sf_dir).where(F.size("x") > 0).select("frame_no", i0(8 * peak).alias("b"), i0(S.lit(8)).alias("top"))
    return f.select("frame_no", F.round("b", 6).alias("i0"), F.round(F.col("b") / F.col("top"), 8).alias("weight"))


ORACLES["bessel"] = f"""WITH {FRAMES_SQL}, t AS (SELECT k, CAST(factorial(CAST(k AS INTEGER)) AS DOUBLE) AS fk FROM range(0, 26) r(k)), p AS (SELECT frame_no, max(abs(greatest(least(x, 1.0), -1.0))) AS p FROM f GROUP BY 1), b AS (SELECT frame_no, sum(pow(pow(4 * p, k) / fk, 2)) AS b FROM p, t GROUP BY 1)
SELECT frame_no, round(b, 6) AS i0, round(b / (SELECT sum(pow(pow(4, k) / fk, 2)) FROM t), 8) AS weight FROM b"""


def bessel_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``bessel`` gives, of every sample of a frame."""
    b = frames(spark, sf_dir).select("frame_no", F.posexplode(F.transform("x", lambda v: i0(8 * F.abs(S.clamp(v))))).alias("i", "b"), i0(S.lit(8)).alias("top"))
    return b.select("frame_no", F.col("i").cast("bigint").alias("i"), F.round("b", 6).alias("i0"), F.round(F.col("b") / F.col("top"), 8).alias("weight"))


ORACLES["bessel_samples"] = f"""WITH {FRAMES_SQL}, t AS (SELECT k, CAST(factorial(CAST(k AS INTEGER)) AS DOUBLE) AS fk FROM range(0, 26) r(k)), b AS (SELECT frame_no, i, sum(pow(pow(4 * abs(greatest(least(x, 1.0), -1.0)), k) / fk, 2)) AS b FROM f, t GROUP BY 1, 2)
SELECT frame_no, i, round(b, 6) AS i0, round(b / (SELECT sum(pow(pow(4, k) / fk, 2)) FROM t), 8) AS weight FROM b"""

QUERIES = {f.__name__: f for f in (fixed_point, checksums, generator, argsort, spacing_repair, slope_ladder, top_lags, seek_table, seek_points, bessel, bessel_samples)}
