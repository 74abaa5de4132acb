"""Near-duplicate texts by min-max hashing, confirmed on full shingle sets.

Signatures keep both the least and the greatest value of every hash function over a text's shingles. Either one agrees
between two sets with probability equal to their Jaccard similarity, and the two are almost independent, so half as many
hash evaluations give a signature of the same length, with lower variance than as many least values. Rows of the signature
are banded; texts that share a band are candidates.

Scale: texts are scanned twice. Copies are folded into one representative before anything is compared. In a bucket,
candidates are first linked to its smallest member only (a star); links are confirmed on the full sets and components
taken. Buckets that still hold several components are compared across them, first by signature, then by full sets, in pairs of
blocks of bounded size that emit no more links than tie components together. So a group of thousands of near copies costs its size in
rows, not its square. Tables between the steps lie in the shared folder.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecrest.llm.graph import connected_components
from wavecrest.llm.shared import cut, drop, maybe_in
from wavecrest.llm.words import Texts, chunks, keys, mix


def min_max(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """(2 * len(factors),): for each function least and greatest value, in turn. At least one shingle is needed."""
    out = np.empty((2, len(factors)), np.uint64)
    out[0], out[1] = np.uint64(2**64 - 1), np.uint64(0)
    for at in range(0, len(shingles), 2048):
        values = shingles[at : at + 2048, None] * factors[None, :]
        values ^= values >> np.uint64(32)
        np.minimum(out[0], values.min(axis=0), out=out[0])
        np.maximum(out[1], values.max(axis=0), out=out[1])
    return out.T.reshape(-1)


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` values."""
    grouped = signature.reshape(-1, rows)
    return mix((grouped * keys(rows, 17)[None, :]).sum(axis=1, dtype=np.uint64) + np.arange(len(grouped), dtype=np.uint64)).view(np.int64)


SIGNED = "__id bigint, __n bigint, __key binary, __bands array<bigint>, __low binary"


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, functions: int, rows: int) -> DataFrame:
    """A row per document: __id, __n (size of its set), __key (a digest of the set; null if empty), __bands, and __low (the
    lowest byte of each value of the signature)."""

    def sign(batches):
        factors = keys(functions, 3)
        for batch in batches:
            for part in chunks(batch, "__text"):
                words = Texts(part.column("__text"), lower=True).words()
                ns, digests, bands, lows = [], [], [np.zeros(0, np.int64)], []
                for s in words.shingles(words.hashes(), size):
                    ns.append(len(s))
                    if len(s):
                        signature = min_max(s, factors)
                        digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                        bands.append(band_keys(signature, rows))
                        lows.append(mix(signature).astype(np.uint8).tobytes())
                    else:
                        digests.append(None)
                        bands.append(np.zeros(0, np.int64))
                        lows.append(None)
                ends = np.cumsum([len(b) for b in bands]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("__id").cast(pa.int64()), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(ends, np.concatenate(bands)), pa.array(lows, pa.binary())],
                    ["__id", "__n", "__key", "__bands", "__low"],
                )

    return docs.select(F.col(id_col).cast("bigint").alias("__id"), F.col(text_col).alias("__text")).mapInArrow(sign, SIGNED)


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """__id and __set (sorted shingle hashes) of documents (__id, __text)."""

    def sets(batches):
        for batch in batches:
            for part in chunks(batch, "__text"):
                words = Texts(part.column("__text"), lower=True).words()
                all_sets = [s.view(np.int64) for s in words.shingles(words.hashes(), size)]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in all_sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("__id"), pa.ListArray.from_arrays(ends, np.concatenate(all_sets))], ["__id", "__set"])

    return docs.mapInArrow(sets, "__id bigint, __set array<bigint>")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def check(batches):
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            xo, yo = x.offsets.to_numpy(), y.offsets.to_numpy()
            xv, yv = x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = xv[xo[i] : xo[i + 1]], yv[yo[i] : yo[i + 1]]
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                good[i] = 100 * common >= percent * (len(p) + len(q) - common)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good))

    left = sets.select(F.col("__id").alias("a"), F.col("__set").alias("x"))
    right = sets.select(F.col("__id").alias("b"), F.col("__set").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint")


def dealt(members: DataFrame, block: int, shingles: int) -> DataFrame:
    """members (h, id, n, size and total of the bucket, ...) for each pair (i, j) of blocks of their bucket, with ``mine`` (i or j).
    A block holds about ``block`` members and ``shingles`` shingles, however large the bucket."""
    blocks = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("total") / shingles)).cast("int")
    placed = members.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).drop("blocks", "other", "size", "total")


def together(frame: DataFrame) -> DataFrame:
    return frame.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")


def sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    mine, i, j = group.column("mine").to_numpy(), group.column("i")[0].as_py(), group.column("j")[0].as_py()
    return np.flatnonzero(mine == i), np.flatnonzero(mine == j), i == j


def fixed(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    """A binary column of values of one length, as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def likely(members: DataFrame, percent: int, block: int, shingles: int) -> DataFrame:
    """(h, i, j, mine, id, component): members of a pair of blocks that have a likely partner there in another component.

    Likely: the sizes allow the similarity; the signatures agree in no fewer values than five and a half standard deviations
    below what the similarity gives (which passes over one true pair in tens of millions); and the pair shares no earlier band,
    where it is met already."""
    t = percent / 100

    def pick(batches):
        for group in runs(batches, ["h", "i", "j"]):
            p, q, same = sides(group)
            n, comp, h = (group.column(c).to_numpy() for c in ("n", "component", "h"))
            ok = (comp[p][:, None] != comp[q][None, :]) & (100 * np.minimum(n[p][:, None], n[q][None, :]) >= percent * np.maximum(n[p][:, None], n[q][None, :]))
            r, c = np.nonzero(np.triu(ok, 1) if same else ok)
            low, lists = fixed(group.column("low"), "u1"), group.column("bands").combine_chunks()
            bands = lists.flatten().to_numpy().reshape(group.num_rows, -1)
            hit = np.zeros(group.num_rows, bool)
            least = (t - 5.5 * (t * (1 - t) / low.shape[1]) ** 0.5) * low.shape[1]
            for at in range(0, len(r), 1 << 14):
                a, b = p[r[at : at + (1 << 14)]], q[c[at : at + (1 << 14)]]
                near = (low[a] == low[b]).sum(axis=1) >= least
                a, b = a[near], b[near]
                shared = bands[a] == bands[b]
                first = shared.argmax(axis=1)
                here = bands[a, first] == h[0]
                hit[a[here]] = hit[b[here]] = True
            if hit.any():
                out = group.select(["h", "i", "j", "mine", "id", "component"]).filter(pa.array(hit)).combine_chunks()
                yield out.to_batches()[0]

    rows = together(dealt(members, block, shingles))
    return rows.select("h", "i", "j", "mine", "id", "n", "component", "low", "bands").mapInArrow(pick, "h bigint, i int, j int, mine int, id bigint, component bigint")


def links_across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members (h, i, j, mine, id, component) of a pair of blocks, confirmed on the full sets: of those
    between different components, as many as tie together what they tie together."""

    def compare(batches):
        for group in runs(batches, ["h", "i", "j"]):
            p, q, same = sides(group)
            ids, comp = group.column("id").to_numpy(), group.column("component").to_numpy()
            arrays = group.column("__set").combine_chunks()
            ends, values = arrays.offsets.to_numpy(), arrays.values.to_numpy()
            n = np.diff(ends)
            owner = np.concatenate([np.full(n[k], x) for x, k in enumerate(q)])
            flat = np.concatenate([values[ends[k] : ends[k + 1]] for k in q])
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            root: dict[int, int] = {}

            def find(x, root=root):
                while root.get(x, x) != x:
                    x = root[x]
                return x

            a_out, b_out = [], []
            for x, k in enumerate(p):
                mine = values[ends[k] : ends[k + 1]]
                lo, hi = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
                m = hi - lo
                at = np.repeat(lo - np.cumsum(m) + m, m) + np.arange(int(m.sum()))
                common = np.bincount(owner[at], minlength=len(q))
                good = 100 * common >= percent * (n[k] + n[q] - common)
                good &= comp[q] != comp[k]
                if same:
                    good[: x + 1] = False
                for y in np.flatnonzero(good).tolist():
                    u, v = find(int(comp[k])), find(int(comp[q[y]]))
                    if u != v:
                        root[max(u, v)] = min(u, v)
                        a_out.append(ids[k])
                        b_out.append(ids[q[y]])
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    rows = members.join(sets.withColumnRenamed("__id", "id"), "id").select("h", "i", "j", "mine", "id", "component", "__set")
    return together(rows).mapInArrow(compare, "a bigint, b bigint").distinct()


def runs(batches, by: list[str]):
    """Tables of the rows that agree in the columns ``by``, of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in by]
        starts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        starts = [0, *starts.tolist()]
        for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            key = tuple(c[start] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    percent: int = 85,
    functions: int = 90,
    rows: int = 6,
    block: int = 256,
    block_shingles: int = 1 << 18,
) -> DataFrame:
    """Returns one row per row of docs: id_col, n_shingles, component_id (the smallest id that can be reached by links,
    itself included) and kept (id = component_id).

    Texts are lower-cased in A-Z and cut into words at ASCII white space; a set is the distinct shingles of ``size``
    words, or the whole sequence of a shorter text. Two texts are linked if 100 * intersection >= percent * union of
    their sets. 2 * functions / rows bands of ``rows`` values give candidates: by default 30 bands of 6, which miss a pair of
    similarity 0.85 once in a million.

    Null, empty and blank texts have an empty set, are linked with nothing and kept. Rows that repeat an id count as one
    document with each of their texts; rows with a null id are linked with nothing. An empty table gives an empty result. Other
    columns are ignored, so their names can't clash.
    """
    if 2 * functions % rows:
        raise ValueError("rows must divide twice the number of functions")
    signed = cut(signatures(docs, id_col, text_col, size, functions, rows))
    full = signed.where("__n > 0 and __id is not null")
    folded = full.groupBy("__key").agg(F.min(F.struct("__id", "__n", "__bands", "__low")).alias("r"))
    reps = cut(folded.select("__key", F.col("r.__id").alias("id"), F.col("r.__n").alias("n"), F.col("r.__bands").alias("bands"), F.col("r.__low").alias("low")))

    # the key of a band holds its number, so that a bucket is told by the key alone
    bands = reps.select("id", "n", F.explode("bands").alias("h"))
    buckets = bands.groupBy("h").agg(F.count("*").alias("size"), F.sum("n").alias("total"), F.min("id").alias("first")).where("size > 1")
    members = cut(bands.join(buckets, "h"))

    wanted = cut(members.select(F.col("id").alias("__id")).distinct())
    texts = docs.select(F.col(id_col).cast("bigint").alias("__id"), F.col(text_col).alias("__text"))
    maybe = maybe_in(wanted.select(F.xxhash64("__id").alias("key")))
    sets = cut(shingle_sets(texts.where(maybe(F.xxhash64("__id"))).join(wanted, "__id", "left_semi"), size))

    stars = members.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    links = cut(confirm(stars, sets, percent))
    tied = connected_components(links)

    labelled = cut(members.join(tied, "id", "left").select("h", "id", "n", "size", "total", F.coalesce("component", "id").alias("component")))
    mixed = labelled.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("h")
    open_members = labelled.join(mixed, "h").join(reps.select("id", "low", "bands"), "id")
    drop(members, wanted)
    rest = cut(likely(open_members, percent, block, block_shingles))
    drop(labelled)
    more = cut(links_across(rest, sets, percent))
    drop(rest, sets)

    # copies, and rows that repeat an id, tie to their representative
    copies = full.join(reps.select("__key", "id"), "__key").where("id <> __id").select(F.col("id").alias("a"), F.col("__id").alias("b"))
    parts = connected_components(links.unionAll(more).unionAll(copies))
    drop(reps, links, more)
    out = signed.join(parts, signed["__id"] == parts["id"], "left")
    component = F.coalesce("component", "__id")
    return out.select(F.col("__id").alias(id_col), F.col("__n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("__id") == component, F.lit(True)).alias("kept"))
