"""States carried along channels of any length: window sequences, held peaks and trackers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrest.functions import signal as S
from wavecrest.operators import scan
from wavecrest.operators.bridge import CHANNELS_SQL, FRAMES_SQL, channels, frames

ORACLES: dict[str, str] = {}

# Fixed values of the attack detector and the window decision: sub-blocks of a block, jump over the baseline, share of the baseline that stays, and
# how far behind an attack in the newer block, and before one in the older, a split of the short windows lies.
PARTS, JUMP, STAYS, BEHIND, AHEAD, PAIR = 8, 8.0, 0.7, 4, 4, 2


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """channel, block, x (its samples in order) of rows (channel, i, x)."""
    samples = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    return rows.groupBy("channel", F.floor(F.col("i") / size).alias("block")).agg(samples.alias("x"))


def attacks(rows: DataFrame, part: int, floor: float) -> DataFrame:
    """channel, block, attack and position (the sub-block of the block's first attack, or 0) of blocks of ``PARTS`` sub-blocks of ``part`` samples.

    The energy of first differences in a sub-block is an attack if it is over 8 times the baseline and over ``floor``. The baseline becomes
    the greater of the energy and of 0.7 of itself and 0.3 of the energy, so a block is one map max(b, c y + d), and baselines come from a tree of them.
    A channel starts from silence; samples that its last block lacks have no energy."""
    b = blocks(rows, part * PARTS)
    ends = b.select(F.col("channel").alias("of"), (F.col("block") + 1).alias("next"), F.element_at("x", -1).alias("before"))
    b = b.join(ends, F.col("channel").eqNullSafe(F.col("of")) & (F.col("block") == F.col("next")), "left")
    rise = F.transform("x", lambda v, i: F.pow(v - F.coalesce(F.when(i > 0, F.get("x", i - 1)).otherwise(F.col("before")), S.lit(0)), S.lit(2)))
    b = b.select("channel", "block", rise.alias("d"))
    energy = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda w: S.total(F.slice("d", w * part + 1, part)))
    b = b.select("channel", "block", energy.alias("e"))
    steps = F.transform("e", lambda v: scan.ramp(v, S.lit(STAYS), v * (1 - STAYS)))
    b = b.withColumn("step", F.reduce(F.slice(steps, 2, PARTS), F.get(steps, F.lit(0)), scan.ramp_compose))
    b = scan.states_before(b, ["channel"], "block", "step", scan.ramp_compose, scan.ramp_apply, S.lit(0), name="base")

    def go(a: Column, v: Column) -> Column:
        hit = F.when((a["hit"] < 0) & (v > JUMP * a["base"]) & (v > floor), a["w"]).otherwise(a["hit"])
        return F.struct(F.greatest(v, STAYS * a["base"] + (1 - STAYS) * v).alias("base"), (a["w"] + 1).alias("w"), hit.alias("hit"))

    hit = F.reduce("e", F.struct(F.col("base").alias("base"), F.lit(0).alias("w"), F.lit(-1).alias("hit")), go)["hit"]
    return b.select("channel", "block", (hit >= 0).alias("attack"), F.greatest(hit, F.lit(0)).cast("bigint").alias("position"))


def sequence(found: DataFrame) -> DataFrame:
    """channel, frame, sequence (long, start, short, stop), bridged, groups (sizes of the groups of the 8 short windows, else empty) of the blocks of ``attacks``.

    Frame j covers blocks j - 1 and j, the last one the last block and what follows. It is short if either has an attack, and a bridge is short too: a frame between a short one and
    one that will be. Before a short frame lies a start, behind one a stop. Whether the frame before was short is a chain of two states. The windows are split where the
    attack lies: 4 sub-blocks on from it in the newer block (7 at most), or else 4 back in the older one."""
    near = [F.struct((F.col("block") + 1 - k).alias("frame"), F.lit(k).alias("k")) for k in range(3)]
    f = found.select("channel", "attack", "position", F.inline(F.array(*near))).where("frame >= 0")
    of = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    attack = [F.coalesce(of(k, "attack"), F.lit(False)).alias(f"a{k}") for k in range(3)]
    f = f.groupBy("channel", "frame").agg(*attack, of(0, "position").alias("p0"), of(1, "position").alias("p1"))
    f = f.withColumns({"own": F.col("a0") | F.col("a1"), "next": F.col("a1") | F.col("a2")})
    step = F.array(F.col("own").cast("int"), (F.col("own") | F.col("next")).cast("int"))
    f = scan.states_before(f.withColumn("step", step), ["channel"], "frame", "step", scan.table_compose, scan.table_apply, F.lit(0), name="prev")
    short = scan.table_apply(F.col("prev"), F.col("step")) == 1
    kind = F.when(short, "short").when(F.col("next"), "start").when(F.col("prev") == 1, "stop").otherwise("long")
    split = F.when(F.col("a1"), F.least(F.col("p1") + BEHIND, F.lit(PARTS - 1))).when(F.col("a0"), F.greatest(F.col("p0") - AHEAD, F.lit(0))).otherwise(0)
    pair = F.least(F.lit(PARTS) - split, F.lit(PAIR))
    sizes = F.filter(F.array(split, pair, PARTS - split - pair), lambda n: n > 0)
    groups = F.when(short, F.array_join(F.transform(sizes, lambda n: n.cast("string")), "+")).otherwise("")
    return f.select("channel", "frame", kind.alias("sequence"), (short & ~F.col("own")).alias("bridged"), groups.alias("groups"))


def window_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of each channel's frames of two samples a sub-block, with their look-ahead, bridges and groups."""
    return sequence(attacks(channels(spark, sf_dir), 2, 225.0))


ORACLES["window_sequence"] = f"""WITH RECURSIVE {CHANNELS_SQL}, d AS (SELECT channel, i, pow(x - lag(x, 1, 0) OVER (PARTITION BY channel ORDER BY i), 2) AS d FROM c),
n AS (SELECT channel, max(i) // 16 + 1 AS blocks FROM c GROUP BY 1), g AS (SELECT channel, i // 2 AS k, sum(d) AS e FROM d GROUP BY 1, 2), e AS (SELECT n.channel, t.k, coalesce(g.e, 0) AS e FROM n CROSS JOIN range(0, 8 * 1000) t(k) LEFT JOIN g ON g.channel = n.channel AND g.k = t.k WHERE t.k < 8 * n.blocks),
s AS (SELECT channel, CAST(0 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS base FROM n UNION ALL SELECT s.channel, s.k + 1, CASE WHEN s.base > e.e THEN 0.7 * s.base + 0.3 * e.e ELSE e.e END FROM s JOIN e ON e.channel = s.channel AND e.k = s.k),
h AS (SELECT e.channel, e.k // 8 AS block, min(e.k % 8) FILTER (e.e > 8 * s.base AND e.e > 225) AS p FROM e JOIN s ON s.channel = e.channel AND s.k = e.k GROUP BY 1, 2),
f AS (SELECT n.channel, t.frame, a.p AS p0, b.p AS p1, b.p IS NOT NULL OR c.p IS NOT NULL AS nxt, a.p IS NOT NULL OR b.p IS NOT NULL AS own FROM n CROSS JOIN range(0, 1001) t(frame) LEFT JOIN h a ON a.channel = n.channel AND a.block = t.frame - 1 LEFT JOIN h b ON b.channel = n.channel AND b.block = t.frame LEFT JOIN h c ON c.channel = n.channel AND c.block = t.frame + 1 WHERE t.frame <= n.blocks),
r AS (SELECT channel, CAST(-1 AS BIGINT) AS frame, false AS prev, false AS short FROM n UNION ALL SELECT f.channel, f.frame, r.short, f.own OR (r.short AND f.nxt) FROM r JOIN f ON f.channel = r.channel AND f.frame = r.frame + 1),
k AS (SELECT f.*, r.prev, r.short, CASE WHEN p1 IS NOT NULL THEN least(p1 + 4, 7) WHEN p0 IS NOT NULL THEN greatest(p0 - 4, 0) ELSE 0 END AS s FROM f JOIN r ON r.channel = f.channel AND r.frame = f.frame)
SELECT channel, frame, CASE WHEN short THEN 'short' WHEN nxt THEN 'start' WHEN prev THEN 'stop' ELSE 'long' END AS sequence, short AND NOT own AS bridged,
CASE WHEN NOT short THEN '' WHEN s = 0 THEN '2+6' WHEN s = 7 THEN '7+1' WHEN s = 6 THEN '6+2' ELSE concat(s, '+2+', 6 - s) END AS groups FROM k"""


def held_peaks(rows: DataFrame, keep: float, size: int = 16) -> DataFrame:
    """channel, i, x and held: the greater of a sample's size and of ``keep`` times what was held before it, from silence on."""
    b = blocks(rows, size)
    steps = F.transform("x", lambda v: scan.ramp(F.abs(v), S.lit(keep), S.lit(0)))
    b = b.withColumn("step", F.reduce(F.slice(steps, 2, size), F.get(steps, F.lit(0)), scan.ramp_compose))
    b = scan.states_before(b, ["channel"], "block", "step", scan.ramp_compose, scan.ramp_apply, S.lit(0), name="y")

    def go(a: Column, v: Column) -> Column:
        now = F.greatest(F.abs(v), keep * a["y"])
        return F.struct(now.alias("y"), F.concat(a["out"], F.array(F.struct(v.alias("x"), now.alias("held")))).alias("out"))

    none = F.array().cast("array<struct<x: double, held: double>>")
    out = F.reduce("x", F.struct(F.col("y").alias("y"), none.alias("out")), go)["out"]
    b = b.select("channel", "block", F.posexplode(out).alias("k", "o"))
    return b.select("channel", (F.col("block") * size + F.col("k")).alias("i"), "o.x", "o.held")


def peak_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The peak held along each channel, falling by a fifth a sample."""
    return held_peaks(channels(spark, sf_dir), 0.8).select("channel", "i", F.round("held", 6).alias("held"))


ORACLES["peak_decay"] = f"WITH {CHANNELS_SQL} SELECT a.channel, a.i, round(max(abs(b.x) * pow(0.8, a.i - b.i)), 6) AS held FROM c a JOIN c b ON b.channel = a.channel AND b.i <= a.i GROUP BY 1, 2"


def rate_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each sample of a frame, as a level, is above a slow mean, between -1.5 and 3; the mean follows by a fiftieth of that. The mean at the frame's end, the sum of what is
    above or below it, and how often it met a bound. Clamped steps don't compose to maps of a fixed size, so this is an ordered fold in the row."""
    start = F.struct(S.lit(0).alias("mean"), S.lit(0).alias("sum"), F.lit(0).cast("bigint").alias("bound"))

    def go(a: Column, v: Column) -> Column:
        over = 20 * v - a["mean"]
        t = S.clamp(over, -1.5, 3.0)
        return F.struct((a["mean"] + 0.02 * t).alias("mean"), (a["sum"] + t).alias("sum"), (a["bound"] + (t != over).cast("bigint")).alias("bound"))

    f = frames(spark, sf_dir).where(F.size("x") > 0).select("frame_no", F.reduce("x", start, go).alias("r"))
    return f.select("frame_no", F.round("r.mean", 6).alias("mean"), F.round("r.sum", 5).alias("above"), F.col("r.bound").alias("bounded"))


ORACLES["rate_tracker"] = f"""WITH RECURSIVE {FRAMES_SQL}, r AS (SELECT frame_no, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS mean, CAST(0 AS DOUBLE) AS above, CAST(0 AS BIGINT) AS bounded FROM f WHERE i = 0
UNION ALL SELECT frame_no, i + 1, mean + 0.02 * t, above + t, bounded + CAST(t <> o AS BIGINT) FROM (SELECT r.*, 20 * f.x - mean AS o, greatest(least(20 * f.x - mean, 3.0), -1.5) AS t FROM r JOIN f ON f.frame_no = r.frame_no AND f.i = r.i))
SELECT frame_no, round(mean, 6) AS mean, round(above, 5) AS above, bounded FROM r QUALIFY row_number() OVER (PARTITION BY frame_no ORDER BY i DESC) = 1"""

QUERIES = {f.__name__: f for f in (window_sequence, peak_decay, rate_tracker)}
