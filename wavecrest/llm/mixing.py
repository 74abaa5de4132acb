"""Mixing overlapping sources to target weights with a min-cost flow.

Documents are summed by membership pattern (the set of sources they belong to). Word capacity flows from patterns to source
quotas; each further pass over a pattern costs more than the one before (convex costs), so the flow repeats as little as it can.
Documents are then chosen by a seeded hash: every document of a pattern gets the whole passes, and a seeded part of them one more.

Scale: the driver sees sums by pattern and source only, a row for each pattern that occurs, and solves 200,000 overlapping ones in seconds. Choosing the seeded part
takes no sort of a source: sums over 256 ranges of the hash find the range in which the quota is filled, sums over 256
ranges of that range narrow it down, and only documents of this 65,536th part of a pattern are put in order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavecrest.llm.shared import cut
from wavecrest.llm.words import Texts, chunks


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """docs (columns of any names but __size) with text_col replaced by __size, its number of words."""
    rest = [c for c in docs.columns if c != text_col]
    schema = docs.select(*rest).schema.add("__size", "long")

    def count(batches):
        for batch in batches:
            for part in chunks(batch, text_col):
                sizes = pa.array(Texts(part.column(text_col)).words().counts.astype(np.int64))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), sizes], [*rest, "__size"])

    return docs.mapInArrow(count, schema)


def fill_targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of total by weight, none above ``most`` times its size; what is over is shared again by weight."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        unit = left / sum(weights[i] for i in open_) if left > 0 else 0.0
        over = {i for i in open_ if unit * weights[i] > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ -= over
    return out


def route(capacity: list[int], member_of: list[list[int]], quotas: list[int], passes: int) -> list[dict[int, int]]:
    """Min-cost flow from patterns to quotas: words that pattern p gives to source s.

    The k-th pass over a pattern's words costs 2k - 1 a word, so that n passes cost n squared. Fills the quotas as far as
    capacities and memberships allow. Giving a word to one source or another costs the same, so a cheapest way to the quotas that are left always takes the
    lowest pass that has one: the flow of least cost is a greatest flow of first passes, enlarged by one of second passes, and so on, each found by blocking flows along
    shortest ways. A pattern of one source that no other pattern has can only give to that one, so the search is over the patterns of overlapping sources."""
    use = Counter(s for mine in member_of for s in mine)
    alone = [len(mine) == 1 and use[mine[0]] == 1 for mine in member_of]
    given: list[dict[int, int]] = [{} for _ in capacity]
    users: list[list[int]] = [[] for _ in quotas]
    need = list(quotas)
    for p, mine in enumerate(member_of):
        if alone[p]:
            if words := min(quotas[mine[0]], passes * capacity[p]):
                given[p][mine[0]] = words
        else:
            for s in mine:
                users[s].append(p)
    rest = [p for p, a in enumerate(alone) if not a and capacity[p] and member_of[p]]
    for _ in range(passes):
        left = {p: capacity[p] for p in rest}
        while _enlarge(left, need, given, member_of, users):
            left = {p: c for p, c in left.items() if c}
    return given


def _enlarge(left: dict[int, int], need: list[int], given: list[dict[int, int]], member_of: list[list[int]], users: list[list[int]]) -> bool:
    """A blocking flow from the patterns with words left to the sources in need, along shortest ways: a pattern gives to a source, which hands back what it has from
    another pattern, which gives to another source. Returns whether there was one. Patterns are nodes from 0 on, sources from -1 down."""
    depth = dict.fromkeys(left, 0)
    front, found = list(left), False
    while front and not found:
        behind = []
        for u in front:
            for v in ([-1 - s for s in member_of[u]] if u >= 0 else [p for p in users[-1 - u] if given[p].get(-1 - u)]):
                if v not in depth:
                    depth[v] = depth[u] + 1
                    behind.append(v)
                    found = found or (v < 0 and need[-1 - v] > 0)
        front = behind
    if not found:
        return False
    tried: dict[int, int] = {}
    for first in left:
        way = [first]
        while way and left[first]:
            u = way[-1]
            if u < 0 and need[-1 - u] > 0:
                back = [given[p][-1 - s] for s, p in zip(way[1::2], way[2::2], strict=False)]
                words = min(left[first], need[-1 - u], *back)
                left[first] -= words
                need[-1 - u] -= words
                for p, s in zip(way[::2], way[1::2], strict=True):
                    given[p][-1 - s] = given[p].get(-1 - s, 0) + words
                for s, p in zip(way[1::2], way[2::2], strict=False):
                    given[p][-1 - s] -= words
                    if not given[p][-1 - s]:
                        del given[p][-1 - s]
                way = [first]
                continue
            ahead = member_of[u] if u >= 0 else users[-1 - u]
            at = tried.get(u, 0)
            if at == len(ahead):
                way.pop()
                if way:
                    tried[way[-1]] = tried.get(way[-1], 0) + 1
                continue
            v = -1 - ahead[at] if u >= 0 else ahead[at]
            if depth.get(v) == depth[u] + 1 and (u >= 0 or given[v].get(-1 - u)):
                way.append(v)
            else:
                tried[u] = at + 1
    return True


def cycle_weights(sources: list[str | None]) -> list[float]:
    """1, 2, 3, repeating."""
    return [1.0 + i % 3 for i in range(len(sources))]


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sources: Column | None = None,
    weights: Callable[[list[str | None]], list[float]] = cycle_weights,
    total: Callable[[int], float] = float,
    passes: int = 3,
    seed: int = 7,
) -> DataFrame:
    """Returns a row per row of docs: id_col, pattern (its sources, as JSON), size (words of its text), source_size and
    target (sums over its sources), copies, and taken (copies * size).

    ``sources`` is an array column of the sources of a row (default: of ``source`` alone). Sources are put in order by code
    point, null last, and given ``weights``; they share ``total`` of the sum of all sizes (by default all of it). A target above
    ``passes`` times its source's size is cut to that, and the excess shared again by weight. No row is copied more than ``passes`` times.
    What a pattern gives differs from the flow by at most half a document.

    Null and empty texts have size 0 and take 0. An empty or null array of sources takes part in nothing. Repeated rows are chosen one
    by one. Reruns agree: the choice is by a hash of id and seed, ties by id and size. Other columns are ignored. The sums by pattern, a
    row each, are solved in one place, where a pattern takes about a kilobyte.
    """
    sources = F.array("source") if sources is None else sources
    key = F.to_json(F.array_sort(F.array_distinct(sources.cast("array<string>"))), {"ignoreNullFields": "false"})
    rows = word_counts(docs.select(F.col(id_col).cast("bigint").alias("__id"), F.col(text_col).alias("__text"), F.coalesce(key, F.lit("[]")).alias("__pattern")), "__text")
    # 16 bits of a seeded hash, and all of it for the last step
    rows = cut(rows.withColumn("__h", F.xxhash64(F.lit(seed), "__id")))
    rows = rows.withColumns({"__b1": F.shiftrightunsigned("__h", 56), "__b2": F.shiftrightunsigned("__h", 48).bitwiseAND(255)})

    sums = rows.groupBy("__pattern").agg(F.sum("__size").alias("size")).select("__pattern", "size", F.from_json("__pattern", "array<string>").alias("members"))
    found = sorted(sums.collect(), key=lambda r: r[0])
    names = sorted({s for r in found for s in r["members"]}, key=lambda s: (s is None, s or ""))
    place = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for r in found:
        for s in r["members"]:
            sizes[place[s]] += r["size"]
    everything = sum(r["size"] for r in found if r["members"])
    targets = fill_targets(sizes, weights(names), total(everything), passes)
    flows = route([r["size"] for r in found], [[place[s] for s in r["members"]] for r in found], [round(t) for t in targets], passes)

    plan = []
    for r, flow in zip(found, flows, strict=True):
        out = sum(flow.values())
        whole = out // r["size"] if r["size"] else 0
        mine = [place[s] for s in r["members"]]
        plan.append((r["__pattern"], sum(sizes[s] for s in mine), float(sum(targets[s] for s in mine)), whole, out - whole * r["size"]))
    spark = docs.sparkSession
    plans = spark.createDataFrame(plan, "__pattern string, source_size bigint, target double, __whole bigint, __rest bigint")

    # where in the order of the hash each pattern's rest is filled
    def narrow(frame: DataFrame, bucket: str, edge: DataFrame) -> DataFrame:
        by = frame.groupBy("__pattern", bucket).agg(F.sum("__size").alias("s"))
        w = Window.partitionBy("__pattern").orderBy(bucket)
        by = by.withColumn("to", F.sum("s").over(w)).join(edge.withColumnRenamed("__pattern", "__p"), F.col("__pattern") == F.col("__p"))
        by = by.where((F.col("to") - F.col("s") <= F.col("__rest")) & (F.col("to") > F.col("__rest")))
        return by.select("__pattern", F.col(bucket).alias("e"), (F.col("__rest") - F.col("to") + F.col("s")).alias("__rest"))

    first = narrow(rows, "__b1", plans.where("__rest > 0").select("__pattern", "__rest")).withColumnsRenamed({"e": "__e1", "__rest": "__r1"})
    inside = rows.join(first, "__pattern").where("__b1 = __e1")
    second = narrow(inside, "__b2", first.select("__pattern", F.col("__r1").alias("__rest"))).withColumnsRenamed({"e": "__e2", "__rest": "__r2"})
    edges = cut(plans.join(first.drop("__r1"), "__pattern", "left").join(second, "__pattern", "left"))

    joined = rows.join(edges, "__pattern")
    at_edge = (F.col("__b1") == F.col("__e1")) & (F.col("__b2") == F.col("__e2"))
    before = (F.col("__b1") < F.col("__e1")) | ((F.col("__b1") == F.col("__e1")) & (F.col("__b2") < F.col("__e2")))
    w = Window.partitionBy("__pattern").orderBy("__h", "__id", "__size").rowsBetween(Window.unboundedPreceding, 0)
    edge = joined.where(at_edge).withColumn("__more", (2 * F.sum("__size").over(w) - F.col("__size") <= 2 * F.col("__r2")).cast("int"))
    rest = joined.where(~F.coalesce(at_edge, F.lit(False))).withColumn("__more", F.coalesce(before, F.lit(False)).cast("int"))
    copies = F.col("__whole") + F.col("__more")
    return edge.unionByName(rest).select(
        F.col("__id").alias(id_col), F.col("__pattern").alias("pattern"), F.col("__size").alias("size"), "source_size", "target",
        copies.alias("copies"), (copies * F.col("__size")).alias("taken"),
    )
