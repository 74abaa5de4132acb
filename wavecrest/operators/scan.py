"""Chains along a long group, as a tree: what a state becomes under the rows before each row, without any task that holds a group.

A row's step is a map from a state to the next. Where maps can be composed to maps of the same size, ranges of ``width`` rows are composed first,
then ranges of ranges, until a group is one range; the states at the ranges' starts then come down the same tree. So a group of any length, a third of all rows
included, is many small tasks, and each level has a ``width``-th of the rows of the one below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavecrest.operators.ranks import joined

Compose = Callable[[Column, Column], Column]


def states_before(rows: DataFrame, by: list[str], index: str, step: str, compose: Compose, apply: Compose, start: Column, width: int = 32, name: str = "state") -> DataFrame:
    """rows with the state before each of them: ``start`` under the steps of all rows of smaller index (whole, from 0, distinct in a group).
    compose(a, b) is the step that does a, then b; apply(state, step) the state behind a step. Groups may be null."""
    last = rows.agg(F.max(index)).first()[0]

    def down(level: DataFrame, last: int) -> DataFrame:
        data = [c for c in level.columns if c not in (*by, index, step)]
        item = F.struct(F.col(index).alias("k"), F.col(step).alias("s"), F.struct(F.lit(0).alias("__none"), *data).alias("d"))
        # a step is in order of its index alone, which is distinct, so that what can't be compared is never compared
        in_order = F.array_sort(F.collect_list(item), lambda x, y: F.when(x["k"] < y["k"], -1).when(x["k"] > y["k"], 1).otherwise(0))
        groups = level.groupBy(*by, F.floor(F.col(index) / width).alias("__up")).agg(in_order.alias("__items"))
        if last < width:
            groups = groups.withColumn("__start", start)
        else:
            steps = F.transform("__items", lambda x: x["s"])
            whole = F.reduce(F.slice(steps, 2, F.size(steps)), F.get(steps, F.lit(0)), compose)
            above = down(groups.select(*by, "__up", whole.alias(step)).withColumnRenamed("__up", index), last // width)
            groups = joined(groups, above.select(*by, F.col(index).alias("__up"), F.col(name).alias("__start")), [*by, "__up"])

        def go(a: Column, x: Column) -> Column:
            return F.struct(apply(a["now"], x["s"]).alias("now"), F.concat(a["out"], F.array(a["now"])).alias("out"))

        states = F.reduce("__items", F.struct(F.col("__start").alias("now"), F.array_remove(F.array("__start"), F.col("__start")).alias("out")), go)["out"]
        one = groups.select(*by, F.inline(F.arrays_zip(F.col("__items").alias("x"), states.alias("y"))))
        return one.select(*by, F.col("x.k").alias(index), F.col("x.s").alias(step), *(F.col(f"x.d.{c}").alias(c) for c in data), F.col("y").alias(name))

    return down(rows, last or 0)


# Maps from one of n states to another: an array, whose element s is where s goes.
def table_compose(a: Column, b: Column) -> Column:
    return F.transform(a, lambda s: F.get(b, s))


def table_apply(state: Column, step: Column) -> Column:
    return F.get(step, state)


# Maps y -> max(b, c y + d) with c >= 0: decays, running maxima, exponential means and mixtures of them.
def ramp(b: Column, c: Column, d: Column) -> Column:
    return F.struct(b.alias("b"), c.alias("c"), d.alias("d"))


def ramp_compose(p: Column, q: Column) -> Column:
    return ramp(F.greatest(q["b"], q["c"] * p["b"] + q["d"]), p["c"] * q["c"], q["c"] * p["d"] + q["d"])


def ramp_apply(y: Column, step: Column) -> Column:
    return F.greatest(step["b"], step["c"] * y + step["d"])
