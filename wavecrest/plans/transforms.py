"""Lapped transforms: long, start, stop and short windows with alias butterflies, and the inverse whose overlapped halves give the samples back."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrest.functions import signal as S
from wavecrest.operators.bridge import FRAMES_SQL, frames

ORACLES: dict[str, str] = {}

# Fixed values of the hybrid filter bank: coefficients of the alias butterflies.
BUTTERFLIES = [-0.6, -0.535, -0.33, -0.185, -0.095, -0.041, -0.0142, -0.0037]
#: Samples of a band in a frame; bands of a frame of 64 samples, the last one filled up with zeros; lines of a short window.
LINES, BANDS, SHORT = 18, 4, 6
KINDS = ("long", "start", "stop")


def window(kind: str, n: int) -> float:
    """The window of 36 samples: a sine; before short windows it falls late and fast, behind them it rises so."""
    sine, quick = math.sin(math.pi / 36 * (n + 0.5)), lambda m: math.sin(math.pi / 12 * (m + 0.5))
    if kind == "start":
        return sine if n < 18 else 1.0 if n < 24 else quick(n - 18) if n < 30 else 0.0
    if kind == "stop":
        return 0.0 if n < 6 else quick(n - 6) if n < 12 else 1.0 if n < 18 else sine
    return sine


def cosines(spark: SparkSession) -> DataFrame:
    """kind and its windowed cosines, a row of 36 for each of 18 lines; a table of three rows."""
    line = lambda kind, k: [window(kind, n) * math.cos(math.pi / 72 * (2 * n + 19) * (2 * k + 1)) / 288 for n in range(36)]
    return spark.createDataFrame([(kind, [line(kind, k) for k in range(LINES)]) for kind in KINDS], "kind string, cosines array<array<double>>")


def dot(x: Column, y: Column) -> Column:
    return S.total(F.zip_with(x, y, lambda a, b: a * b))


def neighbours(rows: DataFrame, number: str, x: str, before: int, after: int) -> DataFrame:
    """number, x and the x of rows numbered one less (``prev``) or more (``next``), null where there is none: one partially aggregated exchange."""
    near = F.array(*[F.struct((F.col(number) - k).alias("at"), F.lit(k).alias("k")) for k in range(-before, after + 1)])
    spread = rows.select(F.col(x).alias("v"), F.inline(near))
    of = lambda k: F.max(F.when(F.col("k") == k, F.col("v")))
    return spread.groupBy(F.col("at").alias(number)).agg(of(0).alias(x), of(-1).alias("prev"), of(1).alias("next")).where(F.col(x).isNotNull())


def banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_no and spans: for each band the 18 samples of the frame before and the frame's own. Odd samples of odd bands are turned round."""
    f = frames(spark, sf_dir).where("frame_no is not null").select("frame_no", "x")
    cut = lambda b: F.transform(F.sequence(F.lit(0), F.lit(LINES - 1)), lambda i: F.coalesce(F.get("x", b * LINES + i), S.lit(0)) * F.when((F.pmod(b, F.lit(2)) == 1) & (F.pmod(i, F.lit(2)) == 1), -1).otherwise(1))
    f = f.select("frame_no", F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), cut).alias("own"))
    f = neighbours(f, "frame_no", "own", 1, 0)
    silence = F.array(*[F.array(*[S.lit(0)] * LINES)] * BANDS)
    return f.select("frame_no", F.zip_with(F.coalesce("prev", silence), "own", lambda a, b: F.concat(a, b)).alias("spans"))


def without_alias(lines: Column) -> Column:
    """Lines of all bands after the butterflies between neighbouring bands: the 8 last of one with the 8 first of the next, mirrored."""
    cs, ca = (F.array(*[S.lit(v) for v in values]) for values in ([1 / math.sqrt(1 + c * c) for c in BUTTERFLIES], [c / math.sqrt(1 + c * c) for c in BUTTERFLIES]))
    n = len(BUTTERFLIES)

    def one(all_lines: Column, own: Column, b: Column) -> Column:
        def line(v: Column, k: Column) -> Column:
            up, mirror = LINES - 1 - k, lambda other: F.get(F.get(all_lines, other), LINES - 1 - k)
            high = v * F.get(cs, up) + mirror(b + 1) * F.get(ca, up)
            low = v * F.get(cs, k) - mirror(b - 1) * F.get(ca, k)
            return F.when((k >= LINES - n) & (b < BANDS - 1), high).when((k < n) & (b > 0), low).otherwise(v)

        return F.transform(own, line)

    return S.let(lines, lambda a: F.transform(a, lambda own, b: one(a, own, b)))


def lapped_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """18 lines of each of four bands of a frame, over it and the frame before, under a long, start or stop window in turn, after the butterflies."""
    kinds = F.array(*map(F.lit, KINDS))
    f = banded(spark, sf_dir).withColumn("kind", F.get(kinds, F.pmod("frame_no", F.lit(3)).cast("int")))
    f = f.join(F.broadcast(cosines(spark)), "kind")
    lines = F.transform("spans", lambda x: F.transform("cosines", lambda c: dot(x, c)))
    out = f.select("frame_no", "kind", F.posexplode(without_alias(lines)).alias("band", "v"))
    out = out.select("frame_no", "kind", F.col("band").cast("bigint").alias("band"), F.posexplode("v").alias("k", "v"))
    return out.select("frame_no", "kind", "band", F.col("k").cast("bigint").alias("k"), (F.round(F.col("v") * 1e3, 6) + 0.0).alias("line"))


BANDS_SQL = FRAMES_SQL + """, b AS (SELECT v.frame_no, s.band, t.n, coalesce(f.x, 0) * CASE WHEN s.band % 2 = 1 AND t.n % 2 = 1 THEN -1 ELSE 1 END AS x FROM (SELECT DISTINCT frame_no FROM f) v CROSS JOIN range(0, 4) s(band) CROSS JOIN range(0, 18) t(n) LEFT JOIN f ON f.frame_no = v.frame_no AND f.i = s.band * 18 + t.n),
sp AS (SELECT frame_no, band, n + 18 AS n, x FROM b UNION ALL SELECT o.frame_no, p.band, p.n, p.x FROM b p JOIN (SELECT DISTINCT frame_no FROM f) o ON o.frame_no = p.frame_no + 1)"""
ORACLES["lapped_transform"] = f"""WITH {BANDS_SQL}, w AS (SELECT kind, n, CASE WHEN kind = 1 AND n >= 18 THEN CASE WHEN n < 24 THEN 1 WHEN n < 30 THEN sin(pi() / 12 * (n - 18 + 0.5)) ELSE 0 END WHEN kind = 2 AND n < 18 THEN CASE WHEN n < 6 THEN 0 WHEN n < 12 THEN sin(pi() / 12 * (n - 6 + 0.5)) ELSE 1 END ELSE sin(pi() / 36 * (n + 0.5)) END AS w FROM range(0, 3) a(kind), range(0, 36) t(n)),
c AS (SELECT kind, n, k, w * cos(pi() / 72 * (2 * n + 19) * (2 * k + 1)) / 288 AS c FROM w, range(0, 18) t(k)), l AS (SELECT frame_no, band, k, sum(x * c) AS v FROM sp JOIN c ON c.n = sp.n AND c.kind = sp.frame_no % 3 GROUP BY 1, 2, 3),
g AS (SELECT i, 1 / sqrt(1 + c * c) AS cs, c / sqrt(1 + c * c) AS ca FROM (SELECT unnest([-0.6, -0.535, -0.33, -0.185, -0.095, -0.041, -0.0142, -0.0037]::DOUBLE[]) AS c, unnest(range(0, 8)) AS i)),
o AS (SELECT l.frame_no, l.band, l.k, CASE WHEN l.k >= 10 AND l.band < 3 THEN l.v * g.cs + u.v * g.ca WHEN l.k < 8 AND l.band > 0 THEN l.v * g.cs - d.v * g.ca ELSE l.v END AS v
FROM l LEFT JOIN g ON g.i = CASE WHEN l.k >= 10 THEN 17 - l.k ELSE l.k END LEFT JOIN l u ON u.frame_no = l.frame_no AND u.band = l.band + 1 AND u.k = 17 - l.k LEFT JOIN l d ON d.frame_no = l.frame_no AND d.band = l.band - 1 AND d.k = 17 - l.k)
SELECT frame_no, ['long', 'start', 'stop'][frame_no % 3 + 1] AS kind, band, k, round(v * 1e3, 6) + 0.0 AS line FROM o"""


def lapped_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three short windows of 12 samples, half overlapping, in the middle of each band's 36: 6 lines of each."""
    f = banded(spark, sf_dir)
    rows = F.array(*[F.array(*[S.lit(math.sin(math.pi / 12 * (n + 0.5)) * math.cos(math.pi / 24 * (2 * n + 7) * (2 * k + 1)) / 96) for n in range(12)]) for k in range(SHORT)])
    lines = F.transform("spans", lambda x: F.transform(F.array(*map(F.lit, (0, 1, 2))), lambda w: F.transform(rows, lambda c: dot(F.slice(x, SHORT * w + SHORT + 1, 12), c))))
    out = f.select("frame_no", F.posexplode(lines).alias("band", "v")).select("frame_no", "band", F.posexplode("v").alias("win", "v")).select("frame_no", "band", "win", F.posexplode("v").alias("k", "v"))
    return out.select("frame_no", *[F.col(c).cast("bigint").alias(c) for c in ("band", "win", "k")], (F.round(F.col("v") * 1e3, 6) + 0.0).alias("line"))


ORACLES["lapped_short"] = f"""WITH {BANDS_SQL}, c AS (SELECT n, k, sin(pi() / 12 * (n + 0.5)) * cos(pi() / 24 * (2 * n + 7) * (2 * k + 1)) / 96 AS c FROM range(0, 12) t(n), range(0, 6) u(k)),
a AS (SELECT o.frame_no, o.band, w.win, c.k, sum(coalesce(sp.x, 0) * c.c) AS v FROM (SELECT DISTINCT frame_no, band FROM b) o CROSS JOIN range(0, 3) w(win) CROSS JOIN c LEFT JOIN sp ON sp.frame_no = o.frame_no AND sp.band = o.band AND sp.n = 6 + 6 * w.win + c.n GROUP BY 1, 2, 3, 4)
SELECT frame_no, band, win, k, round(v * 1e3, 6) + 0.0 AS line FROM a"""


def slope(n: int, m: int) -> float:
    """A window of 2 m samples whose squares add up to one over half of it, and which is smooth at its ends."""
    return math.sin(math.pi / 2 * math.sin(math.pi * (n + 0.5) / (2 * m)) ** 2)


def restored(blocks: DataFrame, m: int) -> DataFrame:
    """block, power (of its ``m`` lines), x, back: blocks (block, x: m samples) are transformed over themselves and the block before, transformed back by the direct sum,
    and the halves of neighbouring windows added. Beyond what there is the signal is 0."""
    cos = [[slope(n, m) * math.cos(math.pi / m * (n + 0.5 + m / 2) * (k + 0.5)) for n in range(2 * m)] for k in range(m)]
    table = lambda rows: F.array(*[F.array(*map(S.lit, r)) for r in rows])
    forward, first, last = table(cos), table([[c[n] for c in cos] for n in range(m)]), table([[c[m + n] for c in cos] for n in range(m)])
    silence = F.array(*[S.lit(0)] * m)
    b = neighbours(blocks, "block", "x", 1, 1)
    lines = lambda old, new: F.transform(forward, lambda c: dot(F.concat(old, new), c))
    b = b.select("block", "x", lines(F.coalesce("prev", silence), F.col("x")).alias("here"), lines(F.col("x"), F.coalesce("next", silence)).alias("behind"))
    half = lambda rows, spectrum: F.transform(rows, lambda c: dot(F.col(spectrum), c))
    back = F.zip_with(half(last, "here"), half(first, "behind"), lambda p, q: (p + q) * (2 / m))
    return b.select("block", S.energy(F.col("here")).alias("power"), "x", back.alias("back"))


def lapped_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames as one signal in blocks of 16: the power of each block's lines, and its samples as they come back."""
    f = frames(spark, sf_dir).where("frame_no is not null and size(x) > 0")
    fill = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.get("x", i), S.lit(0)))
    blocks = f.select("frame_no", fill.alias("x")).select(F.inline(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct((F.col("frame_no") * 4 + k).alias("block"), F.slice("x", 16 * k + 1, 16).alias("x")))))
    out = restored(blocks, 16).select("block", F.round("power", 6).alias("power"), F.posexplode("back").alias("i", "y"))
    return out.select("block", "power", F.col("i").cast("bigint").alias("i"), (F.round("y", 6) + 0.0).alias("y"))


ORACLES["lapped_inverse"] = f"""WITH {FRAMES_SQL}, b AS (SELECT frame_no * 4 + i // 16 AS block, i % 16 AS i, x FROM f), sp AS (SELECT block, i + 16 AS n, x FROM b UNION ALL SELECT block + 1, i, x FROM b),
c AS (SELECT n, k, sin(pi() / 2 * pow(sin(pi() * (n + 0.5) / 32), 2)) * cos(pi() / 16 * (n + 0.5 + 8) * (k + 0.5)) AS c FROM range(0, 32) t(n), range(0, 16) u(k)),
l AS (SELECT block, k, sum(x * c) AS v FROM sp JOIN c USING (n) GROUP BY 1, 2), p AS (SELECT block, sum(v * v) AS power FROM l GROUP BY 1)
SELECT block, round(power, 6) AS power, i, round(x, 6) + 0.0 AS y FROM b JOIN p USING (block)"""

QUERIES = {f.__name__: f for f in (lapped_transform, lapped_short, lapped_inverse)}
