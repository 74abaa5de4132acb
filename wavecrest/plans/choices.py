"""Searches that refine their best candidate, repairs within bounds, channels rebuilt from positions, long coded numbers, and the league as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrest.functions import signal as S
from wavecrest.operators.bridge import FRAMES_SQL, PAIRS_SQL, frames, pairs, table
from wavecrest.plans.rules import MEASURED_SQL, measured
from wavecrest.plans.spectrum import bands

ORACLES: dict[str, str] = {}

# The factors that are tried at best quality, the fine steps around the best of them in their order, and the least factor.
FACTORS = [1.0, 1.02, 1.05, 1.08, 1.11, 1.15, 1.19, 1.24, 1.30, 1.38, 1.48, 1.60]
STEPS, FINE, LEAST_FACTOR = [-2, -1, 1, 2], 0.015, 0.98


def factor_refined(spark: SparkSession, sf_dir: str, step: float = 0.02) -> DataFrame:
    """The factor before quantising that brings back the frame with the least error: the first best of twelve, then one of four fine steps
    around it if that is better still. No factor is below 0.98."""

    def tried(factor: Column) -> Column:
        back = lambda v: S.power_dequantise(S.power_quantise(v * factor, step), step) - v
        return F.struct(F.round(S.energy(F.transform("x", back)), 9).alias("e"), factor.alias("factor"))

    def first(best: Column, c: Column) -> Column:
        return F.when(c["e"] < best["e"], c).otherwise(best)

    f = frames(spark, sf_dir).where(F.size("x") > 0)
    coarse = F.transform(F.array(*map(S.lit, FACTORS)), tried)
    f = f.withColumn("c", F.reduce(coarse, F.struct(S.lit(float("inf")).alias("e"), S.lit(0).alias("factor")), first))
    near = F.filter(F.transform(F.array(*map(F.lit, STEPS)), lambda k: F.col("c.factor") + k * FINE), lambda v: v >= LEAST_FACTOR)
    f = f.withColumn("b", F.reduce(F.transform(near, tried), F.col("c"), first))
    return f.select("frame_no", F.round("c.factor", 3).alias("coarse"), F.round("b.factor", 3).alias("factor"), F.round("b.e", 6).alias("error"))


ORACLES["factor_refined"] = f"""WITH {FRAMES_SQL}, t AS (SELECT * FROM (VALUES (0, 1.0::DOUBLE), (1, 1.02), (2, 1.05), (3, 1.08), (4, 1.11), (5, 1.15), (6, 1.19), (7, 1.24), (8, 1.30), (9, 1.38), (10, 1.48), (11, 1.60)) v(k, f)),
e AS (SELECT frame_no, k, t.f AS fa, round(sum(pow(sign(x) * pow(floor(pow(abs(x * t.f) / 0.02, 0.75) + 0.4054), 4 / 3.0) * 0.02 - x, 2)), 9) AS e FROM f, t GROUP BY 1, 2, 3),
c AS (SELECT frame_no, fa, e FROM e QUALIFY row_number() OVER (PARTITION BY frame_no ORDER BY e, k) = 1),
s AS (SELECT c.frame_no, v.o, c.fa + v.s * 0.015::DOUBLE AS fa FROM c, (VALUES (1, -2), (2, -1), (3, 1), (4, 2)) v(o, s) WHERE c.fa + v.s * 0.015::DOUBLE >= 0.98),
u AS (SELECT frame_no, 0 AS o, fa, e FROM c UNION ALL SELECT s.frame_no, o, fa, round(sum(pow(sign(x) * pow(floor(pow(abs(x * fa) / 0.02, 0.75) + 0.4054), 4 / 3.0) * 0.02 - x, 2)), 9) FROM s JOIN f ON f.frame_no = s.frame_no GROUP BY 1, 2, 3),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY frame_no ORDER BY e, o) = 1) SELECT b.frame_no, round(c.fa, 3) AS coarse, round(b.fa, 3) AS factor, round(b.e, 6) AS error FROM b JOIN c ON c.frame_no = b.frame_no"""

# Numbers of a set, the top of their range, rounds of repair.
ORDER, TOP, ROUNDS = 16, 1 << 15, 20


def spaced(v: Column, gap: int) -> Column:
    """16 whole numbers moved apart, at least ``gap`` from one another, from 0 and from 2^15. In each of 20 rounds the closest pair (or end; the first of
    equal ones) is moved apart about its middle, which keeps clear of what the others need. Where that isn't enough, the numbers are put in order and pushed up from
    the low end, then down from the high one."""
    at = F.sequence(F.lit(0), F.lit(ORDER))
    none = F.lit(None).cast("int")

    def one(v: Column, _: Column) -> Column:
        room = F.transform(at, lambda i: F.coalesce(F.get(v, i), F.lit(TOP)) - gap - F.coalesce(F.when(i > 0, F.get(v, i - 1)), F.lit(0)))
        worst = F.array_position(room, F.array_min(room)).cast("int") - 1

        def moved(w: Column) -> Column:
            middle = F.shiftright(F.get(v, w - 1) + F.get(v, w) + 1, 1)
            middle = F.greatest(F.least(F.greatest(middle, w * gap + gap // 2), TOP - (ORDER - w) * gap - gap // 2), F.lit(0))
            low = F.when((w > 0) & (w < ORDER), middle - gap // 2).otherwise(none)
            change = lambda x, i: F.when((w == 0) & (i == 0), gap).when((w == ORDER) & (i == ORDER - 1), TOP - gap).when(i == w - 1, low).when(i == w, low + gap).otherwise(x)
            return F.transform(v, change)

        return F.when(F.array_min(room) >= 0, v).otherwise(S.let(worst, moved))

    def pushed(v: Column) -> Column:
        up = F.reduce(F.array_sort(v), F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(F.greatest(x, F.coalesce(F.element_at(F.concat(F.array(F.lit(0)), a), -1), F.lit(0)) + gap))))
        return F.reverse(F.reduce(F.reverse(up), F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(F.least(x, F.element_at(F.concat(F.array(F.lit(TOP)), a), -1) - gap)))))

    return S.let(F.reduce(F.sequence(F.lit(1), F.lit(ROUNDS)), v, one), pushed)


def spaced_numbers(spark: SparkSession, sf_dir: str, gap: int = 600) -> DataFrame:
    """The first 16 samples of each frame as line frequencies, a sixteenth apart and off by the sample, moved at least ``gap`` apart."""
    line = lambda v, i: S.clamp((i + 1.0) / 17 + v / 4, 0.0, 1.0) * (TOP - 1)
    f = frames(spark, sf_dir).where(F.size("x") >= ORDER).select("frame_no", F.transform(F.slice("x", 1, ORDER), lambda v, i: F.floor(line(v, i)).cast("int")).alias("v"))
    f = f.select("frame_no", F.posexplode(F.arrays_zip(F.col("v"), spaced(F.col("v"), gap).alias("y"))).alias("i", "p"))
    return f.select("frame_no", F.col("i").cast("bigint").alias("i"), F.col("p.v").alias("given"), F.col("p.y").alias("spaced"))


ORACLES["spaced_numbers"] = f"""WITH RECURSIVE {FRAMES_SQL}, g AS (SELECT frame_no, list(CAST(floor(greatest(least((i + 1.0::DOUBLE) / 17 + x / 4, 1.0), 0.0) * 32767) AS BIGINT) ORDER BY i) AS v FROM f WHERE i < 16 GROUP BY 1 HAVING count(*) = 16),
r AS (SELECT frame_no, 0 AS n, v FROM g UNION ALL SELECT frame_no, n + 1, CASE WHEN list_min(room) >= 0 THEN v ELSE list_transform(range(0, 16), lambda i: CASE WHEN w = 0 AND i = 0 THEN 600 WHEN w = 16 AND i = 15 THEN 32168
WHEN w BETWEEN 1 AND 15 AND i = w - 1 THEN m - 300 WHEN w BETWEEN 1 AND 15 AND i = w THEN m + 300 ELSE v[i + 1] END) END
FROM (SELECT *, greatest(least(greatest((coalesce(v[w], 0) + coalesce(v[w + 1], 0) + 1) >> 1, w * 600 + 300), 32768 - (16 - w) * 600 - 300), 0) AS m FROM
(SELECT *, list_position(room, list_min(room)) - 1 AS w FROM (SELECT *, list_transform(range(0, 17), lambda i: CASE WHEN i < 16 THEN v[i + 1] ELSE 32768 END - 600 - CASE WHEN i > 0 THEN v[i] ELSE 0 END) AS room FROM r WHERE n < 20)))),
s AS (SELECT frame_no, unnest(range(0, 16)) AS i, unnest(list_sort(v)) AS v FROM r WHERE n = 20), u AS (SELECT frame_no, i, greatest(max(v - i * 600) OVER (PARTITION BY frame_no ORDER BY i), 600) + i * 600 AS v FROM s),
d AS (SELECT frame_no, i, least(min(v - i * 600) OVER (PARTITION BY frame_no ORDER BY i DESC), 32768 - 600 - 15 * 600) + i * 600 AS v FROM u)
SELECT d.frame_no, d.i, CAST(g.v[d.i + 1] AS INTEGER) AS given, CAST(d.v AS INTEGER) AS spaced FROM d JOIN g ON g.frame_no = d.frame_no"""


def intensity_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The right channel made from the left by band: 2^(p / 4) times it at the position p that fits the bands' energies, -30 to 30, turned over where
    the two are against each other."""

    def band(b: Column, both: Column) -> Column:
        l, r = F.transform(both, lambda v: v["l"]), F.transform(both, lambda v: v["r"])  # noqa: E741
        p = S.half_away(S.clamp(2 * F.log2((S.energy(r) + 1e-12) / (S.energy(l) + 1e-12)), -30.0, 30.0))
        scale = F.when(S.total(F.zip_with(l, r, lambda a, b: a * b)) < 0, -1).otherwise(1) * F.pow(S.lit(2), p / 4)
        return F.transform(l, lambda v: F.struct(p.cast("bigint").alias("position"), (v * scale).alias("right")))

    made = F.flatten(bands(F.arrays_zip("l", "r"), band))
    f = pairs(spark, sf_dir).select("frame_no", F.posexplode(made).alias("i", "m"))
    return f.select("frame_no", F.col("i").cast("bigint").alias("i"), "m.position", F.round("m.right", 6).alias("right_made"))


ORACLES["intensity_rebuilt"] = f"""WITH {PAIRS_SQL}, e AS (SELECT frame_no, i // 8 AS band, sum(l * l) AS el, sum(r * r) AS er, sum(l * r) AS lr FROM p GROUP BY 1, 2),
q AS (SELECT *, greatest(least(2 * log2((er + 1e-12) / (el + 1e-12)), 30), -30) AS v FROM e), z AS (SELECT *, CAST(sign(v) * floor(abs(v) + 0.5) AS BIGINT) AS position FROM q)
SELECT p.frame_no, i, position, round(l * CASE WHEN lr < 0 THEN -1 ELSE 1 END * pow(2, position / 4.0), 6) AS right_made FROM p JOIN z ON z.frame_no = p.frame_no AND z.band = p.i // 8"""


def coded_number(v: Column) -> Column:
    """A whole number of up to 36 bits as 1 to 7 bytes: as many leading ones as bytes (none for one), then six bits a byte."""
    low = lambda k: F.shiftright(v, 6 * k).bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))
    hex2 = lambda b: F.lpad(F.hex(b), 2, "0")
    out = F.lit(None).cast("string")
    for n in range(7, 1, -1):
        lead = F.shiftright(v, 6 * (n - 1)).bitwiseOR(F.lit((0xFF << (8 - n)) & 0xFF))
        out = F.when(v < 1 << (5 * n + 1), F.concat(hex2(lead), *(hex2(low(k)) for k in range(n - 2, -1, -1)))).otherwise(out)
    return F.unhex(F.when((v >= 0) & (v < 1 << 7), hex2(v)).when(v >= 0, out))


def number_of(data: Column) -> Column:
    """The number that the first bytes code; null if the first can't open one, or a later one is missing or doesn't go on."""
    def decoded(b: Column) -> Column:
        lead = F.get(b, F.lit(0))
        out = F.lit(None).cast("bigint")
        for n in range(7, 1, -1):
            rest = F.slice(b, 2, n - 1)
            whole = (F.size(rest) == n - 1) & F.forall(rest, lambda x: x.bitwiseAND(F.lit(0xC0)) == 0x80)
            value = F.reduce(rest, lead.bitwiseAND(F.lit((1 << (7 - n)) - 1)), lambda a, x: F.shiftleft(a, 6).bitwiseOR(x.bitwiseAND(F.lit(0x3F))))
            out = F.when(lead < 0x100 - (1 << (7 - n)), F.when(whole, value)).otherwise(out)
        return F.when(lead < 0x80, lead).when(lead >= 0xC0, out)

    values = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.conv(F.hex(F.nullif(F.substring(data, i, F.lit(1)), F.lit(b""))), 16, 10).cast("bigint"))
    return S.let(F.filter(values, lambda x: x.isNotNull()), decoded)


def long_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event numbers spread over 36 bits, shortened by their own size, as coded bytes and read back from them; and read from all but the last byte, which is
    null for all of them."""
    v = F.call_function("shiftright", (F.col("event_id") * 2654435761).bitwiseAND(F.lit((1 << 36) - 1)), F.pmod("event_id", F.lit(36)).cast("int"))
    e = table(spark, sf_dir, "events").where("event_id is not null").select("event_id", coded_number(v).alias("d"))
    short = F.substring(F.col("d"), F.lit(1), F.octet_length("d") - 1)
    return e.select("event_id", F.hex("d").alias("coded"), number_of(F.col("d")).alias("number"), number_of(short).alias("broken_off"))


ORACLES["long_numbers"] = """WITH v AS (SELECT event_id, ((event_id * 2654435761) & 68719476735) >> (event_id % 36) AS v FROM events WHERE event_id IS NOT NULL), n AS (SELECT *, CASE WHEN v < 128 THEN 1 ELSE (SELECT min(k) FROM range(2, 8) t(k) WHERE v < (1::BIGINT << (5 * k + 1)::INT)) END AS n FROM v),
b AS (SELECT event_id, v, CASE WHEN n = 1 THEN [v] ELSE list_concat([(255 << (8 - n)::INT) & 255 | (v >> (6 * (n - 1))::INT)], list_transform(range(2, n + 1), lambda k: ((v >> (6 * (n - k))::INT) & 63) | 128)) END AS b FROM n)
SELECT event_id, array_to_string(list_transform(b, lambda x: printf('%02X', x)), '') AS coded, v AS number, CAST(NULL AS BIGINT) AS broken_off FROM b"""


def league_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The league of each frame as lines of text: a head, and a line for each contender, least noise to mask first, those that failed last and named so."""
    m = measured(spark, sf_dir).select("frame_no", F.format_string("q%d", "bits").alias("name"), "bits", *(F.round(c, 2).alias(c) for c in ("snr", "nmr")), F.round("audible", 1).alias("audible"))
    text = F.when(F.col("nmr").isNull(), F.format_string("%-14s   encode FAILED", "name")).otherwise(F.format_string("%-14s%7.2f%8.2f%6.1f", "name", "snr", "nmr", "audible"))
    rows = m.groupBy("frame_no").agg(F.sort_array(F.collect_list(F.struct(F.col("nmr").isNull().alias("failed"), "nmr", "bits", text.alias("line")))).alias("r"))
    head = F.lit(f"{'encoder':<14}{'SNR':>7}{'NMR':>8}{'aud%':>6}")
    lines = F.concat(F.array(F.format_string("=== frame %d ===", "frame_no"), head), F.transform("r", lambda x: x["line"]))
    return rows.select("frame_no", F.posexplode(lines).alias("n", "line")).select("frame_no", F.col("n").cast("bigint").alias("n"), "line")


ORACLES["league_report"] = f"""WITH {MEASURED_SQL}, r AS (SELECT frame_no, bits, round(snr, 2) AS s, round(nmr, 2) AS n, round(audible, 1) AS a FROM me), o AS (SELECT *, row_number() OVER (PARTITION BY frame_no ORDER BY n IS NULL, n, bits) + 1 AS k FROM r)
SELECT frame_no, k AS n, CASE WHEN n IS NULL THEN printf('%-14s   encode FAILED', concat('q', bits)) ELSE printf('%-14s%7.2f%8.2f%6.1f', concat('q', bits), s, n, a) END AS line FROM o
UNION ALL SELECT DISTINCT frame_no, 0, printf('=== frame %d ===', frame_no) FROM o UNION ALL SELECT DISTINCT frame_no, 1, 'encoder           SNR     NMR  aud%' FROM o"""

QUERIES = {f.__name__: f for f in (factor_refined, spaced_numbers, intensity_rebuilt, long_numbers, league_report)}
