"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecrest.llm.shared import cut, drop


def starry(edges: DataFrame) -> bool:
    """Whether every node of the distinct edges (from u to v) goes to one other at most, and those that others go to go nowhere."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("goes"), F.lit(0).alias("met")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("n").agg(F.sum("goes").alias("goes"), F.max("met").alias("met"))
    return nodes.agg(F.count_if((F.col("goes") > 1) | ((F.col("goes") > 0) & (F.col("met") > 0)))).first()[0] == 0


def connected_components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """Returns (id, component) for each id in ``edges`` (columns a and b, long), where component is the smallest id
    that can be reached. Null ends and loops link nothing, repeated edges count once.

    A large-star step links the larger neighbours of each node to the smallest of its neighbours and itself, a small-star
    step the smaller ones. Each step is a partially aggregated minimum and a join back, so a hub with a third of all edges
    lands in no single task (adaptive execution splits the join); edges never grow in number. Each round is cut with a
    table in the shared folder, and ends as soon as every node that has a parent has one only, and that one none. Steps needed grow with the
    logarithm of the number of nodes.
    """
    e = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e = cut(e)
    for _ in range(max_steps):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least.withColumnRenamed("u", "k"), F.col("u") == F.col("k"))
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        before, e = e, cut(small)
        drop(before)
        if starry(e):
            break
    else:
        raise RuntimeError(f"no components after {max_steps} steps")
    roots = e.select("v").distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots.select("v", "v"))
