"""Numbers, running sums and quantiles of large groups, by ranges first and then within a range, so that no task holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def offsets(totals: DataFrame, by: list[str], bucket: str, value: str, name: str) -> DataFrame:
    """totals (a row per bucket of a group) with the sum of value over the group's earlier buckets. The one window over a whole group, and it
    has a row per bucket."""
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)))


def joined(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """left and right where their columns ``by`` agree, null with null; right's own are left out."""
    names = {c: f"__of_{c}" for c in by}
    on = F.lit(True)
    for c, other in names.items():
        on = on & F.col(c).eqNullSafe(F.col(other))
    return left.join(right.withColumnsRenamed(names), on).drop(*names.values())


def numbered(rows: DataFrame, by: list[str], bucket: Column, order: list[str], name: str) -> DataFrame:
    """rows with their numbers, from 0, in a group by order. ``bucket`` must not fall where order rises."""
    rows = rows.withColumn("__bucket", bucket)
    totals = rows.groupBy(*by, "__bucket").agg(F.count("*").alias("__n"))
    firsts = offsets(totals, by, "__bucket", "__n", "__before").drop("__n")
    number = F.row_number().over(Window.partitionBy(*by, "__bucket").orderBy(*order)) - 1 + F.col("__before")
    return joined(rows, firsts, [*by, "__bucket"]).withColumn(name, number.cast("bigint")).drop("__bucket", "__before")


def sums_below(rows: DataFrame, order: str, value: str, width: float, name: str) -> DataFrame:
    """rows, of distinct order, with the sum of value over all rows of smaller order."""
    rows = rows.withColumn("__bucket", F.floor(F.col(order) / width))
    totals = rows.groupBy("__bucket").agg(F.sum(value).alias("__n")).withColumn("__all", F.lit(0))
    firsts = offsets(totals, ["__all"], "__bucket", "__n", "__before").select("__bucket", "__before")
    within = Window.partitionBy("__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(firsts, "__bucket").withColumn(name, F.col("__before") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("__bucket", "__before")


def quantiles(rows: DataFrame, by: str, value: str, q: float, width: float, name: str) -> DataFrame:
    """by and the exact quantile q of value in each group, interpolated between neighbours. Values are counted by ranges of ``width``; only
    those in the ranges that hold the two neighbours are ranked."""
    rows = rows.where(F.col(value).isNotNull()).select(by, F.col(value).alias("__v"), F.floor(F.col(value) / width).alias("__bucket"))
    totals = rows.groupBy(by, "__bucket").agg(F.count("*").alias("__n"))
    ranges = offsets(totals, [by], "__bucket", "__n", "__before").withColumn("__at", (F.sum("__n").over(Window.partitionBy(by)) - 1) * q)
    holds = lambda place, first, n: (place >= first) & (place < first + n)
    low, high, first, n = F.floor("__at"), F.ceil("__at"), F.col("__before"), F.col("__n")
    ranges = ranges.where(holds(low, first, n) | holds(high, first, n)).drop("__n")
    inside = joined(rows, ranges, [by, "__bucket"])
    counted = inside.groupBy(by, "__bucket", "__v", "__before", "__at").agg(F.count("*").alias("__n"))
    counted = offsets(counted, [by, "__bucket"], "__v", "__n", "__inner").withColumn("__first", F.col("__before") + F.col("__inner"))
    first = F.col("__first")
    picked = counted.groupBy(by).agg(
        F.max(F.when(holds(low, first, n), F.col("__v"))).alias("__low"), F.max(F.when(holds(high, first, n), F.col("__v"))).alias("__high"), F.max("__at").alias("__at")
    )
    return picked.select(by, (F.col("__low") + (F.col("__high") - F.col("__low")) * (F.col("__at") - low)).alias(name))
