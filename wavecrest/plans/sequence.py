"""Prediction, blocking, attacks, overlap, resampling and other operators along a signal."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavecrest.functions import signal as S
from wavecrest.operators.bridge import CHANNELS_SQL, FRAMES_SQL, channels, frames, samples
from wavecrest.operators.ranks import numbered

ORACLES: dict[str, str] = {}
PCM_SQL = FRAMES_SQL + ", q AS (SELECT frame_no, i, CAST(sign(x) * floor(abs(greatest(least(x, 1.0), -1.0) * 32767) + 0.5) AS BIGINT) AS v FROM f)"


def differences(v: Column) -> Column:
    """First differences of an array, from a zero before it."""
    return S.let(v, lambda a: F.transform(a, lambda x, i: x - F.coalesce(F.get(a, i - 1), F.lit(0).cast("bigint"))))


def diff_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals of fixed predictors of order 0 to 4: repeated differences, within the row; sums of their sizes and the best order."""
    v = frames(spark, sf_dir).select("frame_no", F.transform("x", lambda x: S.quantise(x, 16)).alias("o0"))
    for k in range(4):
        v = v.withColumn(f"o{k + 1}", differences(F.col(f"o{k}")))
    cost = [F.reduce(F.transform(F.slice(f"o{k}", F.lit(5), F.greatest(F.size(f"o{k}") - 4, F.lit(0))), lambda x: F.abs(x)), F.lit(0).cast("bigint"), lambda a, x: a + x) for k in range(5)]
    best = F.array_min(F.array(*[F.struct(c.alias("cost"), F.lit(k).cast("bigint").alias("k")) for k, c in enumerate(cost)]))
    return v.select("frame_no", *[c.alias(f"cost{k}") for k, c in enumerate(cost)], best["k"].alias("best_order"))


_lag = "lag({0}, 1, 0) OVER (PARTITION BY frame_no ORDER BY i)"
ORACLES["diff_predict"] = f"""WITH {PCM_SQL}, a AS (SELECT frame_no, i, v AS o0, v - {_lag.format('v')} AS o1 FROM q), b AS (SELECT *, o1 - {_lag.format('o1')} AS o2 FROM a),
c AS (SELECT *, o2 - {_lag.format('o2')} AS o3 FROM b), d AS (SELECT *, o3 - {_lag.format('o3')} AS o4 FROM c),
g AS (SELECT frame_no, CAST(sum(abs(o0)) AS BIGINT) AS cost0, CAST(sum(abs(o1)) AS BIGINT) AS cost1, CAST(sum(abs(o2)) AS BIGINT) AS cost2, CAST(sum(abs(o3)) AS BIGINT) AS cost3, CAST(sum(abs(o4)) AS BIGINT) AS cost4 FROM d WHERE i >= 4 GROUP BY 1)
SELECT *, CAST(CASE least(cost0, cost1, cost2, cost3, cost4) WHEN cost0 THEN 0 WHEN cost1 THEN 1 WHEN cost2 THEN 2 WHEN cost3 THEN 3 ELSE 4 END AS BIGINT) AS best_order FROM g"""


def diff_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-2 residuals undone by two running sums along the frame: the samples come back."""
    v = frames(spark, sf_dir).select("frame_no", F.transform("x", lambda x: S.quantise(x, 16)).alias("v"))
    r = v.select("frame_no", F.posexplode(differences(differences(F.col("v")))).alias("i", "residual"))
    w = Window.partitionBy("frame_no").orderBy("i")
    back = r.withColumn("once", F.sum("residual").over(w)).withColumn("restored", F.sum("once").over(w))
    return back.select("frame_no", F.col("i").cast("bigint").alias("i"), "residual", "restored")


ORACLES["diff_restore"] = f"""WITH {PCM_SQL}, a AS (SELECT frame_no, i, v, v - {_lag.format('v')} AS o1 FROM q)
SELECT frame_no, i, o1 - {_lag.format('o1')} AS residual, v AS restored FROM a"""


def zigzag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed residuals as unsigned numbers, and back."""
    s = samples(spark, sf_dir).withColumn("v", S.quantise(F.col("x"), 16)).withColumn("z", S.zigzag(F.col("v")))
    return s.select("frame_no", "i", "z", S.unzigzag(F.col("z")).alias("back"))


ORACLES["zigzag"] = f"WITH {PCM_SQL} SELECT frame_no, i, CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END AS z, v AS back FROM q"


def rice_param(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parameter, 0 to 14, with the fewest bits for a frame's first differences; of equal ones the least."""
    z = F.transform(differences(F.transform("x", lambda x: S.quantise(x, 16))), S.zigzag)

    def cheapest(z: Column) -> Column:
        unary = lambda k: F.reduce(z, F.lit(0).cast("bigint"), lambda a, x: a + F.shiftright(x, k))
        return F.array_min(F.array(*[F.struct((unary(k) + F.size(z) * (1 + k)).alias("bits"), F.lit(k).cast("bigint").alias("k")) for k in range(15)]))

    return frames(spark, sf_dir).where(F.size("x") > 0).select("frame_no", S.let(z, cheapest).alias("b")).select("frame_no", F.col("b.k").alias("k"), F.col("b.bits").alias("bits"))


ORACLES["rice_param"] = f"""WITH {PCM_SQL}, r AS (SELECT frame_no, v - {_lag.format('v')} AS r FROM q), z AS (SELECT frame_no, CASE WHEN r >= 0 THEN 2 * r ELSE -2 * r - 1 END AS z FROM r),
g AS (SELECT frame_no, k, CAST(sum((z >> CAST(k AS INTEGER)) + 1 + k) AS BIGINT) AS bits FROM z, range(0, 15) t(k) GROUP BY 1, 2)
SELECT frame_no, k, bits FROM g QUALIFY row_number() OVER (PARTITION BY frame_no ORDER BY bits, k) = 1"""


def attack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 8 samples of a channel whose energy is over 6 times the one before, and the kind of block that follows from its
    neighbours: start before an attack, short in it, stop after it, else long."""
    b = channels(spark, sf_dir).groupBy("channel", F.floor(F.col("i") / 8).alias("block")).agg(F.sum(F.col("x") * F.col("x")).alias("e"))
    w = Window.partitionBy("channel").orderBy("block")
    b = b.withColumn("hit", F.coalesce(F.col("e") > 6 * F.lag("e").over(w), F.lit(False)))
    kind = F.when(F.col("hit"), "short").when(F.coalesce(F.lead("hit").over(w), F.lit(False)), "start").when(F.coalesce(F.lag("hit").over(w), F.lit(False)), "stop").otherwise("long")
    return b.select("channel", "block", F.round("e", 4).alias("energy"), "hit", kind.alias("kind"))


ORACLES["attack"] = f"""WITH {CHANNELS_SQL}, b AS (SELECT channel, i // 8 AS block, sum(x * x) AS e FROM c GROUP BY 1, 2), h AS (SELECT *, coalesce(e > 6 * lag(e) OVER w, false) AS hit FROM b WINDOW w AS (PARTITION BY channel ORDER BY block))
SELECT channel, block, round(e, 4) AS energy, hit, CASE WHEN hit THEN 'short' WHEN coalesce(lead(hit) OVER w, false) THEN 'start' WHEN coalesce(lag(hit) OVER w, false) THEN 'stop' ELSE 'long' END AS kind FROM h WINDOW w AS (PARTITION BY channel ORDER BY block)"""


def stationarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block's energy against the mean of it and the seven before."""
    b = channels(spark, sf_dir).groupBy("channel", F.floor(F.col("i") / 8).alias("block")).agg(F.sum(F.col("x") * F.col("x")).alias("e"))
    w = Window.partitionBy("channel").orderBy("block").rowsBetween(-7, 0)
    return b.select("channel", "block", F.round(F.col("e") / (F.avg("e").over(w) + S.TINY), 5).alias("ratio"))


ORACLES["stationarity"] = f"""WITH {CHANNELS_SQL}, b AS (SELECT channel, i // 8 AS block, sum(x * x) AS e FROM c GROUP BY 1, 2)
SELECT channel, block, round(e / (avg(e) OVER (PARTITION BY channel ORDER BY block ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) + 1e-12), 5) AS ratio FROM b"""


def overlap_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of one label under a sine window, each laid half over the one before, summed by absolute place."""
    f = frames(spark, sf_dir).where("label is not null")
    s = numbered(f, ["label"], F.floor(F.col("frame_no") / 65536), ["frame_no"], "k").select("label", "k", F.posexplode("x").alias("i", "x"))
    return s.groupBy("label", (F.col("k") * 32 + F.col("i")).alias("place")).agg(F.round(F.sum(F.col("x") * F.sin((F.col("i") + 0.5) * (math.pi / 64))), 6).alias("x"))


ORACLES["overlap_add"] = f"""WITH {FRAMES_SQL}, k AS (SELECT vec_id AS frame_no, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k FROM embeddings WHERE label IS NOT NULL)
SELECT label, k * 32 + i AS place, round(sum(x * sin((i + 0.5) * pi() / 64)), 6) AS x FROM f JOIN k USING (frame_no) GROUP BY 1, 2"""


def sinc(t: float) -> float:
    return 1.0 if abs(t) < 1e-9 else math.sin(math.pi * t) / (math.pi * t)


def by_phases(x: Column, phases: list[list[float]], step: int, first: int) -> Column:
    """len(phases) output samples for every ``step`` samples of an array. Output k lies at sample k * step / len(phases); the weights of its phase
    apply from ``first`` samples after the sample at or before it. Beyond the ends the signal is 0."""
    up = len(phases)
    weights = F.array(*[F.array(*map(S.lit, p)) for p in phases])
    out = F.sequence(F.lit(0), S.half_away(F.size(x) * (up / step)).cast("int") - 1)

    def one(k: Column) -> Column:
        start = F.floor(k * step / up).cast("int") + first
        taps = F.transform(F.get(weights, F.pmod(k, F.lit(up))), lambda w, d: w * F.coalesce(F.get(x, F.when(start + d >= 0, start + d)), S.lit(0)))
        return S.total(taps)

    return F.when(S.half_away(F.size(x) * (up / step)) > 0, F.transform(out, one))


def resample_2to3(spark: SparkSession, sf_dir: str, half: int = 8) -> DataFrame:
    """Three samples for every two of a frame, by a sinc under a raised cosine whose weights are brought to one; beyond the ends the signal
    is 0, but the weights there count. The weights depend on the phase only."""
    phases = []
    for fraction in (0, 2 / 3, 1 / 3):
        w = [sinc(fraction - j) * (0.5 + 0.5 * math.cos(math.pi * (fraction - j) / half)) for j in range(1 - half, half + 1)]
        phases.append([v / sum(w) for v in w])
    f = frames(spark, sf_dir).where(F.size("x") > 0).select("frame_no", F.posexplode(by_phases(F.col("x"), phases, 2, 1 - half)).alias("k", "y"))
    return f.select("frame_no", F.col("k").cast("bigint").alias("k"), F.round("y", 6).alias("y"))


ORACLES["resample_2to3"] = f"""WITH {FRAMES_SQL}, o AS (SELECT k, k * 2 / 3.0 AS pos, CAST(floor(k * 2 / 3.0) AS BIGINT) + j AS j FROM range(0, 96) a(k), range(-7, 9) b(j)),
w AS (SELECT k, j, CASE WHEN abs(pos - j) < 1e-9 THEN 1 ELSE sin(pi() * (pos - j)) / (pi() * (pos - j)) END * (0.5 + 0.5 * cos(pi() * (pos - j) / 8)) AS w FROM o), t AS (SELECT k, sum(w) AS t FROM w GROUP BY 1)
SELECT frame_no, w.k, round(sum(w * x) / max(t), 6) AS y FROM f JOIN w ON w.j = f.i JOIN t ON t.k = w.k GROUP BY 1, 2"""


def lag_autocorr(spark: SparkSession, sf_dir: str, lags: int = 8) -> DataFrame:
    def r(k: Column) -> Column:
        return S.total(F.transform("x", lambda v, i: v * F.coalesce(F.get("x", i + k), S.lit(0))))

    f = frames(spark, sf_dir).select("frame_no", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(lags)), r)).alias("lag", "r"))
    return f.select("frame_no", F.col("lag").cast("bigint").alias("lag"), F.round("r", 6).alias("r"))


ORACLES["lag_autocorr"] = f"WITH {FRAMES_SQL} SELECT a.frame_no, k AS lag, round(coalesce(sum(a.x * b.x), 0), 6) AS r FROM f a CROSS JOIN range(0, 9) t(k) LEFT JOIN f b ON b.frame_no = a.frame_no AND b.i = a.i + k GROUP BY 1, 2"


def levinson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-2 linear prediction from the autocorrelation, in closed form: coefficients and gain in dB."""
    def r(k: int) -> Column:
        return S.total(F.transform("x", lambda v, i: v * F.coalesce(F.get("x", i + k), S.lit(0))))

    f = frames(spark, sf_dir).select("frame_no", *[r(k).alias(f"r{k}") for k in range(3)]).where("r0 > 1e-9")
    f = f.withColumn("k1", F.col("r1") / F.col("r0")).withColumn("e1", F.col("r0") * (1 - F.col("k1") * F.col("k1")))
    f = f.withColumn("k2", (F.col("r2") - F.col("k1") * F.col("r1")) / (F.col("e1") + 1e-12)).withColumn("e2", F.col("e1") * (1 - F.col("k2") * F.col("k2")))
    return f.select("frame_no", F.round(F.col("k1") - F.col("k2") * F.col("k1"), 5).alias("a1"), F.round("k2", 5).alias("a2"), F.round(S.db(F.col("r0") / (F.col("e2") + 1e-12)), 4).alias("gain_db"))


ORACLES["levinson"] = f"""WITH {FRAMES_SQL}, r AS (SELECT a.frame_no, sum(a.x * a.x) AS r0, coalesce(sum(a.x * b.x), 0) AS r1, coalesce(sum(a.x * c.x), 0) AS r2 FROM f a LEFT JOIN f b ON b.frame_no = a.frame_no AND b.i = a.i + 1 LEFT JOIN f c ON c.frame_no = a.frame_no AND c.i = a.i + 2 GROUP BY 1 HAVING sum(a.x * a.x) > 1e-9),
k AS (SELECT *, r1 / r0 AS k1, r0 * (1 - pow(r1 / r0, 2)) AS e1 FROM r), l AS (SELECT *, (r2 - k1 * r1) / (e1 + 1e-12) AS k2 FROM k)
SELECT frame_no, round(k1 - k2 * k1, 5) AS a1, round(k2, 5) AS a2, round(10 * log10(r0 / (e1 * (1 - k2 * k2) + 1e-12)), 4) AS gain_db FROM l"""


def levinson_orders(spark: SparkSession, sf_dir: str, order: int = 8) -> DataFrame:
    """Linear prediction of an order by Levinson's recursion over the autocorrelation, by an ordered fold in the row: coefficients and gain in dB."""
    def r(k: Column) -> Column:
        return S.total(F.transform("x", lambda v, i: v * F.coalesce(F.get("x", i + k), S.lit(0))))

    f = frames(spark, sf_dir).select("frame_no", F.transform(F.sequence(F.lit(0), F.lit(order)), r).alias("r")).where(F.get("r", F.lit(0)) > 1e-9)
    lag = lambda i: F.get("r", i)

    def step(s: Column, i: Column) -> Column:
        reflection = (lag(i) - S.total(F.transform(s["a"], lambda x, j: x * lag(i - 1 - j)))) / (s["e"] + 1e-12)

        def grown(k: Column) -> Column:
            a = F.concat(F.transform(s["a"], lambda x, j: x - k * F.get(s["a"], i - 2 - j)), F.array(k))
            return F.struct(a.alias("a"), (s["e"] * (1 - k * k)).alias("e"))

        return S.let(reflection, grown)

    start = F.struct(F.array().cast("array<double>").alias("a"), lag(F.lit(0)).alias("e"))
    f = f.select("frame_no", lag(F.lit(0)).alias("r0"), F.reduce(F.sequence(F.lit(1), F.lit(order)), start, step).alias("s"))
    out = f.select("frame_no", F.posexplode("s.a").alias("k", "a"), S.db(F.col("r0") / (F.col("s.e") + 1e-12)).alias("g"))
    return out.select("frame_no", (F.col("k") + 1).cast("bigint").alias("k"), F.round("a", 5).alias("a"), F.round("g", 4).alias("gain_db"))


ORACLES["levinson_orders"] = f"""WITH RECURSIVE {FRAMES_SQL}, g AS (SELECT a.frame_no, k, coalesce(sum(a.x * b.x), 0) AS r FROM f a CROSS JOIN range(0, 9) t(k) LEFT JOIN f b ON b.frame_no = a.frame_no AND b.i = a.i + k GROUP BY 1, 2),
r AS (SELECT frame_no, list(r ORDER BY k) AS r FROM g GROUP BY 1 HAVING list(r ORDER BY k)[1] > 1e-9),
l AS (SELECT frame_no, r, CAST(0 AS BIGINT) AS i, CAST([] AS DOUBLE[]) AS a, r[1] AS e FROM r UNION ALL SELECT frame_no, r, i + 1, list_append(list_transform(a, lambda x, j: x - k * a[i + 1 - j]), k), e * (1 - k * k)
FROM (SELECT *, (r[i + 2] - coalesce(list_sum(list_transform(a, lambda x, j: x * r[i + 2 - j])), 0)) / (e + 1e-12) AS k FROM l WHERE i < 8))
SELECT frame_no, unnest(range(1, 9)) AS k, round(unnest(a), 5) AS a, round(10 * log10(r[1] / (e + 1e-12)), 4) AS gain_db FROM l WHERE i = 8"""


def ema(spark: SparkSession, sf_dir: str, keep: float = 0.8) -> DataFrame:
    """Exponential mean along a frame, y = keep y + (1 - keep) x from the first sample on, by an ordered fold in the row; its last value."""
    first = F.get("x", F.lit(0))
    f = frames(spark, sf_dir).where(F.size("x") > 0)
    return f.select("frame_no", F.round(F.reduce("x", first, lambda y, x: y * keep + x * (1 - keep)), 6).alias("ema"))


ORACLES["ema"] = f"WITH {FRAMES_SQL} SELECT frame_no, round(sum(x * CASE WHEN i = 0 THEN pow(0.8, 63) ELSE 0.2 * pow(0.8, 63 - i) END), 6) AS ema FROM f GROUP BY 1"


def hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A two-level decision along a frame that changes only beyond 0.1 up or -0.1 down: how often it is on, and how often it changes."""
    start = F.struct(F.lit(0).alias("s"), F.lit(0).cast("bigint").alias("on"), F.lit(0).cast("bigint").alias("turns"))

    def step(a: Column, x: Column) -> Column:
        s = F.when(x > 0.1, 1).when(x < -0.1, 0).otherwise(a["s"])
        return F.struct(s.alias("s"), (a["on"] + s).cast("bigint").alias("on"), (a["turns"] + (s != a["s"]).cast("int")).cast("bigint").alias("turns"))

    f = frames(spark, sf_dir).select("frame_no", F.reduce("x", start, step).alias("r"))
    return f.select("frame_no", F.col("r.on").alias("on_count"), F.col("r.turns").alias("turns"))


ORACLES["hysteresis"] = f"""WITH {FRAMES_SQL}, d AS (SELECT frame_no, i, CASE WHEN x > 0.1 THEN 1 WHEN x < -0.1 THEN 0 END AS d FROM f),
s AS (SELECT frame_no, i, coalesce(last_value(d IGNORE NULLS) OVER (PARTITION BY frame_no ORDER BY i), 0) AS s FROM d), t AS (SELECT *, s <> lag(s, 1, 0) OVER (PARTITION BY frame_no ORDER BY i) AS t FROM s)
SELECT frame_no, CAST(sum(s) AS BIGINT) AS on_count, count(*) FILTER (t) AS turns FROM t GROUP BY 1"""


def granule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running position of blocks of up to 10 samples of a channel, ahead by a fixed skip, with the last one marked."""
    b = channels(spark, sf_dir).groupBy("channel", F.floor(F.col("i") / 10).alias("packet")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("channel").orderBy("packet")
    return b.select("channel", "packet", (F.sum("n").over(w) + 312).alias("position"), F.lead("packet").over(w).isNull().alias("is_last"))


ORACLES["granule"] = f"""WITH {CHANNELS_SQL}, b AS (SELECT channel, i // 10 AS packet, count(*) AS n FROM c GROUP BY 1, 2)
SELECT channel, packet, CAST(sum(n) OVER w + 312 AS BIGINT) AS position, lead(packet) OVER w IS NULL AS is_last FROM b WINDOW w AS (PARTITION BY channel ORDER BY packet)"""


def padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame sizes of a fixed rate of 128 kbit/s at 44.1 kHz over a channel's blocks, with the carried remainder in closed form."""
    b = channels(spark, sf_dir).select("channel", F.floor(F.col("i") / 8).alias("block")).distinct()
    byte = lambda k: F.floor(k * (144000 * 128) / 44100)
    size = byte(F.col("block") + 1) - byte(F.col("block"))
    return b.select("channel", "block", size.alias("bytes"), (size - F.lit(144000 * 128 // 44100)).alias("padded"))


ORACLES["padding"] = f"""WITH {CHANNELS_SQL}, b AS (SELECT DISTINCT channel, i // 8 AS block FROM c), s AS (SELECT *, ((block + 1) * 18432000) // 44100 - (block * 18432000) // 44100 AS bytes FROM b)
SELECT channel, block, bytes, bytes - 417 AS padded FROM s"""


def loss_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of over a day between a channel's samples: where, how long in whole hours, and whether the next sample follows within the hour."""
    c = channels(spark, sf_dir)
    w = Window.partitionBy("channel").orderBy("i")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    g = c.select("channel", "i", (F.lead(at).over(w) - at).alias("gap"), (F.lead(at, 2).over(w) - F.lead(at).over(w)).alias("then"))
    return g.where(F.col("gap") > 86_400_000_000).select("channel", "i", F.floor(F.col("gap") / 3_600_000_000).alias("hours"), F.coalesce(F.col("then") <= 3_600_000_000, F.lit(False)).alias("recovers"))


ORACLES["loss_gap"] = f"""WITH {CHANNELS_SQL}, g AS (SELECT channel, i, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS gap, epoch_us(lead(ts, 2) OVER w) - epoch_us(lead(ts) OVER w) AS nxt FROM c WINDOW w AS (PARTITION BY channel ORDER BY i))
SELECT channel, i, gap // 3600000000 AS hours, coalesce(nxt <= 3600000000, false) AS recovers FROM g WHERE gap > 86400000000"""

QUERIES = {f.__name__: f for f in (diff_predict, diff_restore, zigzag, rice_param, attack, stationarity, overlap_add, resample_2to3, lag_autocorr, levinson, levinson_orders, ema, hysteresis, granule, padding, loss_gap)}
