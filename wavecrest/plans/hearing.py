"""What an ear would hear: masks with a threshold in quiet, pitch without doubled octaves, content worth keeping above a cutoff, steadiness of levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrest.functions import signal as S
from wavecrest.operators import scan
from wavecrest.operators.bridge import CHANNELS_SQL, FRAMES_SQL, channels, frames
from wavecrest.operators.ranks import numbered
from wavecrest.plans.spectrum import BARK_SQL, RATE, WIDTH, bands, masks

ORACLES: dict[str, str] = {}

# How far a masker is above what it masks, in dB, if it is noise and how much more if it is a tone; the flatness of a tone.
NOISE_MASKS, TONE_MORE, TONE_FLATNESS = 6.0, 12.0, -20.0


def quiet_db(hz: Column) -> Column:
    """The threshold in quiet of a frequency, in dB."""
    khz = hz / 1000
    return 3.64 * F.pow(khz, S.lit(-0.8)) - 6.5 * F.exp(-0.6 * F.pow(khz - 3.3, S.lit(2))) + 1e-3 * F.pow(khz, S.lit(4))


def masking(values: Column) -> Column:
    """What a band's samples mask in their own place: their energy less an offset that grows as they are less flat."""
    n = F.size(values)
    mean = S.energy(values) / n
    geometric = F.exp(S.total(F.transform(values, lambda v: F.ln(v * v + 1e-30))) / n)
    tone = S.clamp(S.db(geometric / (mean + 1e-30) + 1e-30) / TONE_FLATNESS, 0.0, 1.0)
    return S.energy(values) * F.pow(S.lit(10), -(NOISE_MASKS + TONE_MORE * tone) / 10)


def quiet_masks(spark: SparkSession, sf_dir: str, depths: tuple[int, ...] = (96, 20)) -> DataFrame:
    """The mask of each band in dB: maskers less tonal offsets, spread over critical bands, but no less than the threshold in quiet. The
    threshold's least value lies ``depth`` dB below the loudest band that the label has had up to this frame, a running maximum that comes down a tree of
    ranges, so that no task holds a label. ``quiet`` tells where the threshold rules."""
    f = frames(spark, sf_dir).where(F.size("x") > 0)
    energy = bands(F.col("x"), lambda b, v: S.energy(v))
    f = f.select("frame_no", "label", F.array_max(energy).alias("loudest"), masks(bands(F.col("x"), lambda b, v: masking(v)), 0.0).alias("mask"))
    f = numbered(f, ["label"], F.floor(F.col("frame_no") / 65536), ["frame_no"], "k")
    f = f.withColumn("step", scan.ramp(F.col("loudest"), S.lit(1), S.lit(0)))
    f = scan.states_before(f, ["label"], "k", "step", scan.ramp_compose, scan.ramp_apply, S.lit(0), name="before")
    hearing = F.transform(F.sequence(F.lit(0), F.size("mask") - 1), lambda b: quiet_db((b * WIDTH + WIDTH / 2) * (RATE / 2 / 64)))
    f = f.withColumns({"ref": F.greatest("loudest", "before"), "hearing": hearing}).withColumn("depth", F.explode(F.array(*map(F.lit, depths))))
    f = f.select("frame_no", "depth", "ref", F.array_min("hearing").alias("least"), F.posexplode(F.arrays_zip("mask", "hearing")).alias("band", "m"))
    floor = F.col("ref") * F.pow(S.lit(10), (F.col("m.hearing") - F.col("least") - F.col("depth")) / 10)
    return f.select("frame_no", "depth", F.col("band").cast("bigint").alias("band"), F.round(S.db(F.greatest("m.mask", floor) + 1e-30), 4).alias("mask_db"), (floor > F.col("m.mask")).alias("quiet"))


ORACLES["quiet_masks"] = f"""WITH {FRAMES_SQL}, e AS (SELECT frame_no, label, i // 8 AS band, sum(x * x) AS e, sum(ln(x * x + 1e-30)) AS lg, count(*) AS n FROM f GROUP BY 1, 2, 3),
o AS (SELECT *, e * pow(10, -(6 + 12 * greatest(least(10 * log10(exp(lg / n) / (e / n + 1e-30) + 1e-30) / -20, 1), 0)) / 10) AS em FROM e),
z AS (SELECT DISTINCT band, (band * 8 + 4) * 0.125 AS khz, {BARK_SQL.format('((band * 8 + 4.0) * 125.0)')} AS z FROM e),
h AS (SELECT band, z, 3.64 * pow(khz, -0.8) - 6.5 * exp(-0.6 * pow(khz - 3.3, 2)) + 1e-3 * pow(khz, 4) AS q FROM z),
d AS (SELECT j.band AS j, k.band AS k, j.q AS q, j.z - k.z + 0.474 AS y FROM h j, h k),
m AS (SELECT a.frame_no, a.band, max(d.q) AS q, sum(b.em * pow(10, (15.81 + 7.5 * y - 17.5 * sqrt(1 + y * y)) / 10)) AS mask FROM o a JOIN o b ON a.frame_no = b.frame_no JOIN d ON d.j = a.band AND d.k = b.band GROUP BY 1, 2),
r AS (SELECT frame_no, max(max(e)) OVER (PARTITION BY label ORDER BY frame_no) AS ref FROM e GROUP BY frame_no, label),
t AS (SELECT m.frame_no, depth, band, mask, ref * pow(10, (q - min(q) OVER (PARTITION BY m.frame_no) - depth) / 10) AS fl FROM m JOIN r ON r.frame_no = m.frame_no CROSS JOIN (VALUES (96), (20)) v(depth))
SELECT frame_no, CAST(depth AS INTEGER) AS depth, band, round(10 * log10(greatest(mask, fl) + 1e-30), 4) AS mask_db, fl > mask AS quiet FROM t"""

# Fixed values of the pitch decision. The multiple at which a k-th part of a lag is looked at a second time, for k from 2 (where it is the
# lag and its half); a part's gain must reach a share of the lag's own gain, less the gain of a period that goes on, and at least a floor: more for short parts.
SECOND_LOOK = [3, 2, 3, 2, 5, 2, 3, 2, 3, 2, 5, 2, 3, 2]
SHARE, FLOOR, SHORT_SHARE, SHORT_FLOOR = 0.7, 0.3, 0.85, 0.4
LONGEST, SHORTEST, SPAN, FULL = 24, 3, 10, 32768.0


def lag_sums(y: Column) -> Column:
    """xy and yy by lag, 0 to LONGEST: products of a block's samples with those so much earlier, and the energy of the earlier ones. y holds LONGEST samples of
    history and then the block."""
    now, back = F.slice(y, LONGEST + 1, SPAN), lambda lag: F.slice(y, LONGEST + 1 - lag, F.lit(SPAN))
    lags = F.sequence(F.lit(0), F.lit(LONGEST))
    return F.struct(F.transform(lags, lambda k: S.total(F.zip_with(now, back(k), lambda a, b: a * b))).alias("xy"), F.transform(lags, lambda k: S.energy(back(k))).alias("yy"))


def parts_of_best(t: Column) -> Column:
    """The best lag (least of equal ones) with its gain, and its parts: lags near a k-th of it, whose sums are means of two looks."""
    gain = lambda xy, yy: xy / F.sqrt(1 + F.get(t["yy"], F.lit(0)) * yy)

    def found(lag: Column, xy: Column, yy: Column, k: Column) -> Column:
        return F.struct(k.alias("k"), lag.alias("lag"), xy.alias("xy"), yy.alias("yy"), gain(xy, yy).alias("gain"))

    def score(lag: Column) -> Column:
        xy = F.get(t["xy"], lag)
        return F.struct((-F.when(xy > 0, xy * xy / (F.get(t["yy"], lag) + 1)).otherwise(S.lit(0))).alias("s"), lag.alias("lag"))

    best = F.array_min(F.transform(F.sequence(F.lit(SHORTEST), F.lit(LONGEST - 1)), score))["lag"]

    def parts(t0: Column) -> Column:
        near = lambda n, k: F.floor((2 * n * t0 + k) / (2 * k)).cast("int")
        two = lambda t1: F.when(t0 + t1 > LONGEST, t0).otherwise(t0 + t1)
        looks = [F.struct(F.lit(k).alias("k"), near(1, k).alias("a"), (two(near(1, k)) if k == 2 else near(n, k)).alias("b")) for k, n in enumerate(SECOND_LOOK, 2)]
        mean = lambda v, p: (F.get(t[v], p["a"]) + F.get(t[v], p["b"])) / 2
        tried = F.transform(F.filter(F.array(*looks), lambda p: p["a"] >= SHORTEST), lambda p: found(p["a"], mean("xy", p), mean("yy", p), p["k"]))
        return F.struct(t["xy"].alias("xy"), found(t0, F.get(t["xy"], t0), F.get(t["yy"], t0), F.lit(1)).alias("own"), tried.alias("parts"))

    return S.let(best, parts)


def pitch_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pitch period of each block of 10 samples behind 24 of history, in half samples, and its gain. A lag that is a multiple of the true
    period correlates too, so parts of the best lag are tried, and the smallest that is strong enough wins; it may be weaker where the block before had that period. A
    frame's blocks are an ordered fold in its row; frames too short for one block have none."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("x") - LONGEST) / SPAN).cast("int") - 1), lambda b: F.slice("x", b * SPAN + 1, F.lit(LONGEST + SPAN)))
    f = frames(spark, sf_dir).where(F.size("x") >= LONGEST + SPAN).select("frame_no", blocks.alias("y"))
    f = f.select("frame_no", F.transform("y", lambda y: lag_sums(F.transform(y, lambda v: v * FULL))).alias("t"))
    f = f.select("frame_no", F.transform("t", parts_of_best).alias("b"))

    def go(a: Column, b: Column) -> Column:
        own = b["own"]

        def strong(p: Column) -> Column:
            off = F.abs(p["lag"] - a["lag"])
            held = F.when(off <= 1, a["gain"]).when((off <= 2) & (5 * p["k"] * p["k"] < own["lag"]), a["gain"] / 2).otherwise(S.lit(0))
            least = lambda share, floor: F.greatest(share * own["gain"] - held, S.lit(floor))
            return p["gain"] > F.when(p["lag"] < 3 * SHORTEST, least(SHORT_SHARE, SHORT_FLOOR)).otherwise(least(SHARE, FLOOR))

        def chosen(p: Column) -> Column:
            xy = F.greatest(p["xy"], S.lit(0))
            gain = F.least(F.when(p["yy"] <= xy, S.lit(1)).otherwise(xy / (p["yy"] + 1)), p["gain"])
            left, mid, right = (F.get(b["xy"], p["lag"] + k) for k in (-1, 0, 1))
            side = F.when(right - left > 0.7 * (mid - left), 1).when(left - right > 0.7 * (mid - right), -1).otherwise(0)
            return F.struct(F.greatest(2 * p["lag"] + side, F.lit(2 * SHORTEST)).alias("period"), gain.alias("gain"), p["k"].alias("part"))

        best = S.let(F.coalesce(F.get(F.reverse(F.filter(b["parts"], strong)), F.lit(0)), own), chosen)
        return S.let(best, lambda p: F.struct(F.shiftright(p["period"], 1).alias("lag"), p["gain"].alias("gain"), F.concat(a["out"], F.array(p)).alias("out")))

    start = F.struct(F.lit(0).alias("lag"), S.lit(0).alias("gain"), F.array().cast("array<struct<period: int, gain: double, part: int>>").alias("out"))
    f = f.select("frame_no", F.posexplode(F.reduce("b", start, go)["out"]).alias("block", "p"))
    return f.select("frame_no", F.col("block").cast("bigint").alias("block"), "p.period", "p.part", F.round("p.gain", 5).alias("gain"))


ORACLES["pitch_periods"] = f"""WITH RECURSIVE {FRAMES_SQL}, n AS (SELECT frame_no, (count(*) - 24) // 10 AS blocks FROM f GROUP BY 1), b AS (SELECT frame_no, blk FROM n, range(0, 1000) t(blk) WHERE blk < blocks),
l AS (SELECT b.frame_no, blk, lag, sum(u.x * v.x) * 32768.0 * 32768.0 AS xy, sum(v.x * v.x) * 32768.0 * 32768.0 AS yy FROM b CROSS JOIN range(0, 25) t(lag) JOIN f u ON u.frame_no = b.frame_no AND u.i >= 24 + 10 * blk AND u.i < 34 + 10 * blk JOIN f v ON v.frame_no = u.frame_no AND v.i = u.i - lag GROUP BY 1, 2, 3),
s AS (SELECT frame_no, blk, lag AS t0, xy, yy FROM l WHERE lag BETWEEN 3 AND 23 QUALIFY row_number() OVER (PARTITION BY frame_no, blk ORDER BY CASE WHEN xy > 0 THEN xy * xy / (yy + 1) ELSE 0 END DESC, lag) = 1),
k AS (SELECT frame_no, blk, k, t0, (2 * t0 + k) // (2 * k) AS t1, CASE WHEN k = 2 THEN CASE WHEN (2 * t0 + 2) // 4 + t0 > 24 THEN t0 ELSE (2 * t0 + 2) // 4 + t0 END ELSE (2 * [3, 2, 3, 2, 5, 2, 3, 2, 3, 2, 5, 2, 3, 2][k - 1] * t0 + k) // (2 * k) END AS t2 FROM s, range(2, 16) t(k)),
p AS (SELECT k.frame_no, k.blk, k, t1, (u.xy + v.xy) / 2 AS xy, (u.yy + v.yy) / 2 AS yy FROM k JOIN l u ON u.frame_no = k.frame_no AND u.blk = k.blk AND u.lag = t1 JOIN l v ON v.frame_no = k.frame_no AND v.blk = k.blk AND v.lag = t2 WHERE t1 >= 3
UNION ALL SELECT frame_no, blk, 1, t0, xy, yy FROM s),
g AS (SELECT p.*, s.t0, p.xy / sqrt(1 + z.yy * p.yy) AS g, s.xy / sqrt(1 + z.yy * s.yy) AS g0, u.xy AS x0, v.xy AS x1, w.xy AS x2 FROM p JOIN s ON s.frame_no = p.frame_no AND s.blk = p.blk JOIN l z ON z.frame_no = p.frame_no AND z.blk = p.blk AND z.lag = 0
JOIN l u ON u.frame_no = p.frame_no AND u.blk = p.blk AND u.lag = p.t1 - 1 JOIN l v ON v.frame_no = p.frame_no AND v.blk = p.blk AND v.lag = p.t1 JOIN l w ON w.frame_no = p.frame_no AND w.blk = p.blk AND w.lag = p.t1 + 1),
c AS (SELECT frame_no, blk, k, t0, t1, g, g0, greatest(2 * t1 + CASE WHEN x2 - x0 > 0.7 * (x1 - x0) THEN 1 WHEN x0 - x2 > 0.7 * (x1 - x2) THEN -1 ELSE 0 END, 6) AS period, least(CASE WHEN yy <= greatest(xy, 0) THEN 1 ELSE greatest(xy, 0) / (yy + 1) END, g) AS gain FROM g),
q AS (SELECT frame_no, blk, list({{'k': k, 't0': t0, 't1': t1, 'g': g, 'g0': g0, 'period': period, 'gain': gain}} ORDER BY k) AS cs FROM c GROUP BY 1, 2),
r AS (SELECT frame_no, CAST(-1 AS BIGINT) AS blk, {{'k': 0::BIGINT, 't0': 0::BIGINT, 't1': 0::BIGINT, 'g': 0::DOUBLE, 'g0': 0::DOUBLE, 'period': 0::BIGINT, 'gain': 0::DOUBLE}} AS c FROM n UNION ALL
SELECT r.frame_no, q.blk, list_filter(q.cs, lambda x: x.k = 1 OR x.g > CASE WHEN x.t1 < 9 THEN greatest(0.85 * x.g0 - CASE WHEN abs(x.t1 - r.c.period // 2) <= 1 THEN r.c.gain WHEN abs(x.t1 - r.c.period // 2) <= 2 AND 5 * x.k * x.k < x.t0 THEN r.c.gain / 2 ELSE 0 END, 0.4)
ELSE greatest(0.7 * x.g0 - CASE WHEN abs(x.t1 - r.c.period // 2) <= 1 THEN r.c.gain WHEN abs(x.t1 - r.c.period // 2) <= 2 AND 5 * x.k * x.k < x.t0 THEN r.c.gain / 2 ELSE 0 END, 0.3) END)[-1] FROM r JOIN q ON q.frame_no = r.frame_no AND q.blk = r.blk + 1)
SELECT frame_no, blk AS block, CAST(c.period AS INTEGER) AS period, CAST(c.k AS INTEGER) AS part, round(c.gain, 5) AS gain FROM r WHERE blk >= 0"""


def lowpass_adaptive(spark: SparkSession, sf_dir: str, start: int = 62, share: float = 1e-3) -> DataFrame:
    """Bins from ``start`` on are zeroed, unless they hold more than ``share`` of the frame's energy: then they are content."""
    high = S.energy(F.filter("x", lambda v, i: i >= start))
    f = frames(spark, sf_dir).withColumn("kept", high > share * S.energy(F.col("x")))
    f = f.select("frame_no", "kept", F.posexplode(F.transform("x", lambda v, i: F.when((i >= start) & ~F.col("kept"), S.lit(0)).otherwise(v))).alias("i", "x"))
    return f.select("frame_no", "kept", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x"))


ORACLES["lowpass_adaptive"] = f"""WITH {FRAMES_SQL}, k AS (SELECT frame_no, coalesce(sum(x * x) FILTER (i >= 62), 0) > 1e-3 * sum(x * x) AS kept FROM f GROUP BY 1)
SELECT f.frame_no, kept, i, round(CASE WHEN i >= 62 AND NOT kept THEN 0 ELSE x END, 6) AS x FROM f JOIN k ON k.frame_no = f.frame_no"""


def ring_stationarity(spark: SparkSession, sf_dir: str, ring: int = 8, size: int = 8) -> DataFrame:
    """How steady a channel's level has been over a ring of 8 blocks: the sum of amplitudes over the root of 8 sums of energies, at most 0.99, to the fourth
    power; blocks before the first are silent. Each block is added to those of the next rings that it is in, so the one exchange is by channel and block."""
    b = channels(spark, sf_dir).groupBy("channel", F.floor(F.col("i") / size).alias("of")).agg(S.total(F.array_sort(F.collect_list(F.col("x") * F.col("x")))).alias("e"))
    b = b.select("channel", "e", F.posexplode(F.sequence(F.col("of"), F.col("of") + (ring - 1))).alias("k", "block"))
    b = b.groupBy("channel", "block").agg(F.sum(F.sqrt("e")).alias("l1"), F.sum("e").alias("l2"), F.max((F.col("k") == 0).cast("int")).alias("own")).where("own = 1")
    steady = F.least(S.lit(0.99), F.col("l1") / F.sqrt(1e-15 + ring * F.col("l2")))
    return b.select("channel", "block", F.round(F.pow(steady, S.lit(4)), 6).alias("stationarity"))


ORACLES["ring_stationarity"] = f"""WITH {CHANNELS_SQL}, b AS (SELECT channel, i // 8 AS block, sum(x * x) AS e FROM c GROUP BY 1, 2), r AS (SELECT channel, block, sum(sqrt(e)) OVER w AS l1, sum(e) OVER w AS l2 FROM b WINDOW w AS (PARTITION BY channel ORDER BY block ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))
SELECT channel, block, round(pow(least(0.99, l1 / sqrt(1e-15 + 8 * l2)), 4), 6) AS stationarity FROM r"""

QUERIES = {f.__name__: f for f in (quiet_masks, pitch_periods, lowpass_adaptive, ring_stationarity)}
