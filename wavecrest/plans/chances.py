"""How likely differences are by chance: rank sums with ties, and runs of right answers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrest.functions import signal as S
from wavecrest.operators.bridge import table
from wavecrest.operators.ranks import sums_below

ORACLES: dict[str, str] = {}


def normal_tail(z: Column, terms: int = 80) -> Column:
    """The share of a normal distribution above z >= 0: below 3 by the series of odd powers, above by a continued fraction."""
    steps = F.sequence(F.lit(1), F.lit(terms))
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    series = F.reduce(steps, F.struct(z.alias("t"), z.alias("s")), lambda a, k: S.let(a["t"] * z * z / (2 * k + 1), lambda t: F.struct(t.alias("t"), (a["s"] + t).alias("s"))))["s"]
    fraction = F.reduce(F.reverse(steps), z, lambda a, k: z + k / a)
    return F.when(z < 3, 0.5 - density * series).otherwise(density / fraction)


def binomial_tail(right: Column, n: Column) -> Column:
    """The chance of at least so many right answers of n by a fair coin, from logarithms, so that no number overflows."""
    ways = F.when(right > 0, F.reduce(F.sequence(F.lit(1).cast("bigint"), right), S.lit(0), lambda a, i: a + F.log((n - right + i) / i))).otherwise(S.lit(0))
    start = F.struct(ways.alias("w"), S.lit(0).alias("p"))
    step = lambda a, k: F.struct((a["w"] + F.when(k < n, F.log((n - k) / (k + 1))).otherwise(0)).alias("w"), (a["p"] + F.exp(a["w"] - n * math.log(2))).alias("p"))
    return F.reduce(F.sequence(right, n), start, step)["p"]


def rank_sum_chance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mann-Whitney's U between the values of each type of event and the first type, its z with a variance corrected for ties and half a step of continuity, and the two-sided chance. Values are
    counted by type first. A tie's term depends on both types; that of values which only the first type has is summed once and put right where the other type has them too."""
    e = table(spark, sf_dir, "events").where("value is not null and event_type is not null").select("event_type", F.round("value", 0).alias("value"))
    base = F.col("event_type") == e.select(F.min("event_type")).scalar()
    counted = e.groupBy("event_type", "value").agg(F.count("*").alias("n")).withColumn("is_base", base)
    firsts = counted.groupBy("value").agg(F.sum(F.when(F.col("is_base"), F.col("n")).otherwise(0)).alias("b"))
    below = sums_below(firsts, "value", "b", 1.0, "below")
    tie = lambda t: t * t * t - t
    n, b = F.col("n").cast("double"), F.col("b").cast("double")
    u = counted.where("not is_base").join(below, "value").groupBy(F.col("event_type").alias("kind")).agg(F.sum("n").alias("n"), F.sum(n * (F.col("below") + b / 2)).alias("u"), F.sum(tie(n + b) - tie(b)).alias("ties"))
    mine = counted.where("is_base")
    u = u.withColumns({"m": mine.select(F.sum("n")).scalar(), "own": mine.select(F.sum(tie(n))).scalar()})
    n, m = F.col("n").cast("double"), F.col("m").cast("double")
    u = u.withColumn("variance", n * m / 12 * (n + m + 1 - (F.col("ties") + F.col("own")) / ((n + m) * (n + m - 1))))
    z = (F.abs(F.col("u") - n * m / 2) - 0.5) / F.sqrt("variance")
    u = u.withColumn("z", F.when(F.col("variance") > 0, z))
    p = F.least(2 * F.when(F.col("z") >= 0, normal_tail(F.abs("z"))).otherwise(1 - normal_tail(F.abs("z"))), S.lit(1))
    return u.select("kind", "n", F.col("m").alias("n_base"), F.round("u", 1).alias("u"), F.round("z", 6).alias("z"), F.round(p, 5).alias("p"))


ORACLES["rank_sum_chance"] = """WITH e AS (SELECT event_type, round(value, 0) AS value FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL), b AS (SELECT min(event_type) AS base FROM e), p AS (SELECT k.kind, value, event_type = k.kind AS mine FROM e, b, (SELECT DISTINCT event_type AS kind FROM e, b WHERE event_type <> base) k WHERE event_type IN (k.kind, b.base)),
r AS (SELECT kind, mine, rank() OVER (PARTITION BY kind ORDER BY value) + (count(*) OVER (PARTITION BY kind, value) - 1) / 2.0 AS r FROM p), t AS (SELECT kind, sum(pow(c, 3) - c) AS ties FROM (SELECT kind, value, CAST(count(*) AS DOUBLE) AS c FROM p GROUP BY 1, 2) GROUP BY 1),
u AS (SELECT kind, count(*) FILTER (mine) AS n, count(*) FILTER (NOT mine) AS m, sum(r) FILTER (mine) - count(*) FILTER (mine) * (count(*) FILTER (mine) + 1) / 2.0 AS u FROM r GROUP BY 1),
z AS (SELECT *, (abs(u - CAST(n AS DOUBLE) * m / 2) - 0.5) / sqrt(CAST(n AS DOUBLE) * m / 12 * (n + m + 1 - ties / (CAST(n + m AS DOUBLE) * (n + m - 1)))) AS z FROM u JOIN t USING (kind)),
i AS (SELECT kind, sum(exp(-pow(abs(z) + (s + 0.5) * 1e-4, 2) / 2) * 1e-4) / sqrt(2 * pi()) AS tail FROM z, range(0, 120000) t(s) GROUP BY 1)
SELECT kind, n, m AS n_base, round(u, 1) AS u, round(z, 6) AS z, round(least(1, 2 * CASE WHEN z >= 0 THEN tail ELSE 1 - tail END), 5) AS p FROM z JOIN i USING (kind)"""


def right_by_chance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as answers, right if of a value over 30: how many, and the exact chance of as many or more by a fair coin."""
    e = table(spark, sf_dir, "events").where("value is not null").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 30).alias("correct"))
    return e.select("user_id", "n", "correct", F.round(binomial_tail(F.col("correct"), F.col("n")), 9).alias("p"))


ORACLES["right_by_chance"] = """WITH e AS (SELECT user_id, count(*) AS n, count(*) FILTER (value > 30) AS correct FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT user_id, n, correct, round(sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))), 9) AS p FROM (SELECT *, unnest(range(correct, n + 1)) AS k FROM e) GROUP BY 1, 2, 3"""

QUERIES = {f.__name__: f for f in (rank_sum_chance, right_by_chance)}
