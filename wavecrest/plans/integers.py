"""Integer approximations that are the same to the last bit everywhere, and generators that jump."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrest.functions import signal as S
from wavecrest.operators.bridge import CHANNELS_SQL, FRAMES_SQL, channels, frames, table

ORACLES: dict[str, str] = {}

# Fixed values of the integer cosine and of the logarithm of a tangent: coefficients of their polynomials, in 1 / 32768.
COSINE, LOGARITHM = (-626, 8277, -7651), (-2597, 7932)
# Fixed values of the linear generator (factor, step) and the shifts of the other one, with its first state.
FACTOR, STEP, SHIFTS, FIRST = 1103515245, 12345, (13, 17, 5), 0x1234567
WORD = (1 << 32) - 1


def shift_left(x: Column, n: Column | int) -> Column:
    return F.call_function("shiftleft", x.cast("bigint"), (F.lit(n) if isinstance(n, int) else n).cast("int"))


def shift_right(x: Column, n: Column | int) -> Column:
    return F.call_function("shiftright", x.cast("bigint"), (F.lit(n) if isinstance(n, int) else n).cast("int"))


def product15(a: Column | int, b: Column | int) -> Column:
    """The product of two 16-bit numbers, rounded, without its 15 low bits."""
    return shift_right(F.lit(16384) + (F.lit(a) if isinstance(a, int) else a) * (F.lit(b) if isinstance(b, int) else b), 15)


def bit_length(x: Column) -> Column:
    return F.when(x > 0, F.length(F.bin(x.cast("bigint")))).otherwise(0)


def integer_cosine(x: Column) -> Column:
    """32768 times the cosine of x quarter turns in 1 / 16384, for x from 64 to 16320."""

    def poly(y: Column) -> Column:
        inner = F.lit(COSINE[1]) + product15(COSINE[0], y)
        return 1 + (32767 - y) + product15(y, F.lit(COSINE[2]) + product15(y, inner))

    return S.let(shift_right(4096 + x * x, 13), poly)


def integer_log2_tan(sine: Column, cosine: Column) -> Column:
    """2048 times the binary logarithm of sine / cosine, both from 1 to 32767."""
    part = lambda v: S.let(shift_left(v, 15 - bit_length(v)), lambda y: product15(y, product15(y, LOGARITHM[0]) + LOGARITHM[1]))
    return (bit_length(sine) - bit_length(cosine)) * 2048 + part(sine) - part(cosine)


def integer_root(v: Column) -> Column:
    """The greatest number whose square is at most v."""
    return S.let(F.floor(F.sqrt(v.cast("double"))), lambda r: F.when(r * r > v, r - 1).when((r + 1) * (r + 1) <= v, r + 1).otherwise(r))


def knots(scale: float, at: Column, power: bool) -> Column:
    """The whole number nearest to scale times 2 ** (at / 128), or log2(1 + at / 128)."""
    return S.half_away((F.pow(S.lit(2), at / 128) if power else F.log2(1 + at / 128)) * scale).cast("bigint")


def integer_log2(v: Column) -> Column:
    """65536 times the binary logarithm of v (1 to 2 ** 32 - 1): between 128 knots an octave it is a line."""
    b = bit_length(v) - 1

    def line(u: Column) -> Column:
        at, rest = shift_right(u, 24).bitwiseAND(F.lit(127)), shift_right(u, 16).bitwiseAND(F.lit(255))
        low = knots(65536.0, at, False)
        return shift_left(b, 16) + low + shift_right((knots(65536.0, at + 1, False) - low) * rest, 8)

    return S.let(shift_left(v, 31 - b), line)


def integer_exp2(l: Column, magic: int, most: int) -> Column:  # noqa: E741
    """The whole part of 2 ** (l / 65536) + magic / 65536, at most ``most``."""
    whole, rest = shift_right(l, 16), l.bitwiseAND(F.lit(65535))
    at, r = shift_right(rest, 9).bitwiseAND(F.lit(127)), shift_right(rest, 1).bitwiseAND(F.lit(255))
    low = knots(32768.0, at, True)
    m = low + shift_right((knots(32768.0, at + 1, True) - low) * r, 8)
    q = F.when(whole >= -1, shift_left(m, F.greatest(whole + 1, F.lit(0)))).otherwise(shift_right(m, F.least(-whole - 1, F.lit(63))))
    return F.when(whole >= 15, most).otherwise(F.least(shift_right(q + magic, 16), F.lit(most))).cast("bigint")


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_id is not null").select("event_id", (F.col("event_id") * 2654435761).bitwiseAND(F.lit(WORD)).alias("h"))


def integer_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An angle for each event: its cosine and sine, and the logarithm of its tangent."""
    e = hashed(spark, sf_dir).select("event_id", (64 + F.pmod("h", F.lit(16257))).alias("x"))
    e = e.select("event_id", "x", integer_cosine(F.col("x")).alias("cosine"), integer_cosine(16384 - F.col("x")).alias("sine"))
    return e.select("event_id", "x", "cosine", "sine", integer_log2_tan(F.col("sine"), F.col("cosine")).alias("log2_tan"))


def _cosine_sql(x: str) -> str:
    y = f"((4096 + {x} * {x}) >> 13)"
    inner = f"(8277 + ((16384 - 626 * {y}) >> 15))"
    return f"32768 - {y} + ((16384 + {y} * (-7651 + ((16384 + {y} * {inner}) >> 15))) >> 15)"


def _log_sql(v: str) -> str:
    y = f"({v} << CAST(15 - length(bin({v})) AS INTEGER))"
    return f"((16384 + {y} * (((16384 - 2597 * {y}) >> 15) + 7932)) >> 15)"


ORACLES["integer_angles"] = f"""WITH e AS (SELECT event_id, 64 + ((event_id * 2654435761) & 4294967295) % 16257 AS x FROM events WHERE event_id IS NOT NULL), c AS (SELECT event_id, x, {_cosine_sql('x')} AS cosine, {_cosine_sql('(16384 - x)')} AS sine FROM e)
SELECT event_id, x, cosine, sine, (length(bin(sine)) - length(bin(cosine))) * 2048 + {_log_sql('sine')} - {_log_sql('cosine')} AS log2_tan FROM c"""


def integer_powers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number of 32 bits for each event: its root, its logarithm, and three quarters of that as a power, which quantises it."""
    e = hashed(spark, sf_dir).select("event_id", shift_right(F.col("h"), F.pmod("event_id", F.lit(28))).alias("v")).where("v > 0")
    e = e.select("event_id", "v", integer_root(F.col("v")).alias("root"), integer_log2(F.col("v")).alias("log2"))
    return e.select("event_id", "v", "root", "log2", integer_exp2(shift_right(3 * F.col("log2"), 2) - (12 << 16), 26568, 8191).alias("quantised"))


ORACLES["integer_powers"] = """WITH e AS (SELECT event_id, ((event_id * 2654435761) & 4294967295) >> (event_id % 28) AS v FROM events WHERE event_id IS NOT NULL), t AS (SELECT i, CAST(round(log2(1 + i / 128.0) * 65536) AS BIGINT) AS lg, CAST(round(pow(2.0, i / 128.0) * 32768) AS BIGINT) AS ex FROM range(0, 130) t(i)),
b AS (SELECT event_id, v, length(bin(v)) - 1 AS b FROM e WHERE v > 0), u AS (SELECT *, v << CAST(31 - b AS INTEGER) AS u FROM b), l AS (SELECT u.event_id, u.v, (u.b << 16) + lo.lg + (((hi.lg - lo.lg) * ((u >> 16) & 255)) >> 8) AS log2 FROM u JOIN t lo ON lo.i = (u.u >> 24) & 127 JOIN t hi ON hi.i = lo.i + 1),
q AS (SELECT *, ((3 * log2) >> 2) - 786432 AS l FROM l), p AS (SELECT q.*, l >> 16 AS whole, lo.ex + (((hi.ex - lo.ex) * (((l & 65535) >> 1) & 255)) >> 8) AS m FROM q JOIN t lo ON lo.i = ((l & 65535) >> 9) & 127 JOIN t hi ON hi.i = lo.i + 1)
SELECT event_id, v, CAST(floor(sqrt(CAST(v AS DOUBLE))) AS BIGINT) AS root, log2, CAST(CASE WHEN whole >= 15 THEN 8191 ELSE least((CASE WHEN whole >= -1 THEN m << CAST(whole + 1 AS INTEGER) ELSE m >> CAST(-whole - 1 AS INTEGER) END + 26568) >> 16, 8191) END AS BIGINT) AS quantised FROM p"""


def powers(bits: int = 40) -> list[tuple[int, int]]:
    """The linear generator's 2 ** k steps at once, each as a factor and a step: the map of the power before, done twice."""
    out = [(FACTOR, STEP)]
    for _ in range(bits - 1):
        a, c = out[-1]
        out.append((a * a & WORD, (a * c + c) & WORD))
    return out


def jumped(state: Column, n: Column) -> Column:
    """The linear generator's state n steps on, by the bits of n, so that a sample far on needs none of those before it."""

    def times(a: Column, x: Column) -> Column:
        # in halves of 16 bits, so that no product leaves 63 bits
        return (a * x.bitwiseAND(F.lit(65535)) + shift_left((a * shift_right(x, 16)).bitwiseAND(F.lit(65535)), 16)).bitwiseAND(F.lit(WORD))

    i64 = lambda v: F.lit(v).cast("bigint")
    steps = F.array(*[F.struct(F.lit(k).alias("k"), i64(a).alias("a"), i64(c).alias("c")) for k, (a, c) in enumerate(powers())])
    return F.reduce(steps, state, lambda x, p: F.when(shift_right(n, p["k"]).bitwiseAND(F.lit(1)) == 1, (times(p["a"], x) + p["c"]).bitwiseAND(F.lit(WORD))).otherwise(x))


def generator_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of a generator at each sample of a channel, which its number seeds, without the states before."""
    c = channels(spark, sf_dir).where("channel is not null")
    return c.select("channel", "i", jumped(F.col("channel"), F.col("i") + 1).alias("state"))


ORACLES["generator_jump"] = f"""WITH RECURSIVE {CHANNELS_SQL}, g AS (SELECT DISTINCT channel, CAST(-1 AS BIGINT) AS i, channel AS state FROM c WHERE channel IS NOT NULL UNION ALL SELECT g.channel, g.i + 1, (g.state * 1103515245 + 12345) & 4294967295 FROM g JOIN c ON c.channel = g.channel AND c.i = g.i + 1)
SELECT channel, i, state FROM g WHERE i >= 0"""


def noise_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many samples of noise as a frame has, from three shifts a step of a state that the frame's number changes, scaled to the frame's energy: their sum and largest, and the last state."""

    left = lambda n: lambda v: v.bitwiseXOR(shift_left(v, n).bitwiseAND(F.lit(WORD)))
    right = lambda n: lambda v: v.bitwiseXOR(shift_right(v, n))

    def step(a: Column, _: Column) -> Column:
        x = S.let(S.let(S.let(a["x"], left(SHIFTS[0])), right(SHIFTS[1])), left(SHIFTS[2]))
        return S.let(x, lambda v: F.struct(v.alias("x"), F.concat(a["out"], F.array(shift_right(v, 8) * (2.0 / 16777216) - 1)).alias("out")))

    f = frames(spark, sf_dir).where("frame_no is not null and size(x) > 0")
    start = F.struct((F.lit(FIRST).bitwiseXOR(F.pmod(F.col("frame_no") * 2654435761, F.lit(WORD)))).cast("bigint").alias("x"), F.array().cast("array<double>").alias("out"))
    f = f.select("frame_no", S.energy(F.col("x")).alias("energy"), F.reduce("x", start, step).alias("r"))
    scale = F.sqrt(F.col("energy") / S.energy(F.col("r.out")))
    return f.select("frame_no", F.round(S.total(F.col("r.out")) * scale, 6).alias("total"), F.round(F.array_max(F.transform("r.out", lambda v: F.abs(v))) * scale, 6).alias("largest"), F.col("r.x").alias("state"))


ORACLES["noise_fill"] = f"""WITH RECURSIVE {FRAMES_SQL}, g AS (SELECT frame_no, CAST(-1 AS BIGINT) AS i, xor(CAST(19088743 AS BIGINT), (frame_no * 2654435761) % 4294967295) AS x FROM f WHERE i = 0 UNION ALL
SELECT frame_no, i + 1, xor(b, (b << 5) & 4294967295) FROM (SELECT g.frame_no, g.i, xor(xor(x, (x << 13) & 4294967295), xor(x, (x << 13) & 4294967295) >> 17) AS b FROM (SELECT frame_no, i, x FROM g) g JOIN (SELECT frame_no, i AS fi, x AS x2 FROM f) f(frame_no, fi, x2) ON f.frame_no = g.frame_no AND f.fi = g.i + 1)),
n AS (SELECT g.frame_no, (g.x >> 8) * (2.0::DOUBLE / 16777216) - 1 AS v, g.x, f.x AS s, row_number() OVER (PARTITION BY g.frame_no ORDER BY g.i DESC) AS r FROM g JOIN f ON f.frame_no = g.frame_no AND f.i = g.i WHERE g.i >= 0)
SELECT frame_no, round(sum(v) * sqrt(sum(s * s) / sum(v * v)), 6) AS total, round(max(abs(v)) * sqrt(sum(s * s) / sum(v * v)), 6) AS largest, max(CASE WHEN r = 1 THEN x END) AS state FROM n GROUP BY 1"""

QUERIES = {f.__name__: f for f in (integer_angles, integer_powers, generator_jump, noise_fill)}
