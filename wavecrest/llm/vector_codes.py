"""Vector codes by LAESA pivots: product quantisation in whole numbers, with exact nearest entries found by few distances.

Vectors are cut into equal parts and each part is told by the index of its codebook's nearest entry. A few entries of the first codebook,
far from one another, serve as fixed pivots of their part position. Distances of parts to pivots are measured once and stored beside the parts; each round only those of
the pivots to the entries are new. By the triangle inequality |d(x, p) - d(p, e)| is at most d(x, e) for every pivot p; the
greatest of these orders a part's entries, and exact distances in whole numbers are taken in that order until no further entry can be as near as the best one.

Scale: rows are read once, cut to a table of parts and pivot distances, and stay where they are; a round is one pass that gives, for each task, at most
one sum per codebook component. Only codebooks come to the driver: parts x 256 x components numbers, whatever the number of rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecrest.llm.shared import cut

ENTRIES = 256


def choose_pivots(entries: np.ndarray, n: int) -> np.ndarray:
    """Up to n entries, each the farthest from those chosen before, first the one farthest from the first entry; equal ones aren't chosen twice."""
    x = entries.astype(np.float64)
    far = np.linalg.norm(x - x[0], axis=1)
    chosen = []
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        d = np.linalg.norm(x - x[chosen[-1]], axis=1)
        far = d if len(chosen) == 1 else np.minimum(far, d)
    return entries[chosen or [0]]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(rows, pivots) of distances, in floating point."""
    return np.stack([np.sqrt(((x - p).astype(np.float64) ** 2).sum(axis=1)) for p in pivots], axis=1)


def nearest(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray, step: int = 8, rows: int = 512) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of the nearest entry of each row of x (of equally near ones the lowest), its squared distance, and how many distances were
    evaluated. x and entries are whole numbers; bounds are loosened by more than floating point can be wrong."""
    index, error, evaluated = np.empty(len(x), np.int64), np.empty(len(x), np.int64), 0
    between = distances(entries, pivots)
    for at in range(0, len(x), rows):
        part, own = x[at : at + rows], to_pivots[at : at + rows]
        bound = np.zeros((len(part), len(entries)))
        for k in range(len(pivots)):
            np.maximum(bound, np.abs(own[:, k, None] - between[None, :, k]), out=bound)
        bound = bound * (1 - 1e-9) - 1e-6 - 1e-9 * own.max(axis=1, initial=0)[:, None]
        order = bound.argsort(axis=1)
        bound = np.take_along_axis(bound, order, axis=1)
        best, found = np.full(len(part), np.iinfo(np.int64).max), np.full(len(part), len(entries))
        live = np.arange(len(part))
        for k in range(0, len(entries), step):
            live = live[bound[live, k] <= np.sqrt(best[live].astype(np.float64))]
            if not len(live):
                break
            tried = order[live, k : k + step]
            d = ((part[live, None, :] - entries[tried]) ** 2).sum(axis=2)
            evaluated += d.size
            least = d.min(axis=1)
            first = np.where(d == least[:, None], tried, len(entries)).min(axis=1)
            better = (least < best[live]) | ((least == best[live]) & (first < found[live]))
            best[live[better]], found[live[better]] = least[better], first[better]
        index[at : at + rows], error[at : at + rows] = found, best
    return index, error, evaluated


def compress(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, rounds: int = 4, pivots: int = 12, max_labels: int = 10_000
) -> DataFrame:
    """Returns a row per coded row of table: id_col, code (a byte in hex for each part), error (squared distance to the coded vector), label_error (sum
    of errors over equal labels, nulls together; null if it exceeds a long), codebooks_sha256 (of all entries' components by part, entry and
    place, in decimal, joined by commas), evaluated (exact distances taken for the row's final code, as a mean over its batch).

    Components become floor(1024 x). Codebooks start as the parts of the 256 rows of smallest id (a null id behind all others; of rows that repeat an
    id the order is by content) and are moved ``rounds`` times to the componentwise floor of their parts' mean; an entry nearest to nothing stays. Of equally
    near entries the lowest index is taken. With fewer than 256 rows there are fewer entries.

    Not coded are rows whose vector is null, empty or holds null, infinite or undefined components, and those whose length isn't that of
    the coded row with the smallest id or can't be cut into equal parts. Whole numbers are held within +- sqrt(2**60 / length), 1.3e8 for a length of 64, so that
    errors fit into a long. Repeated rows are coded alike. An empty table, or one without rows to code, gives an empty result. Other columns are ignored.

    The label sums are broadcast if there are at most ``max_labels``, else joined by a shuffle in which large labels are split."""
    spark = table.sparkSession
    label = F.col(label_col).cast("string")
    rows = table.select(F.col(id_col).cast("bigint").alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.coalesce(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False)) & (F.size("v") > 0) & (F.size("v") % parts == 0)
    rows = rows.where(sound)
    limit = F.floor(F.sqrt(F.lit(2.0**60) / F.size("v"))).cast("double")
    rows = rows.select("id", "label", F.transform("v", lambda x: F.floor(F.greatest(F.least(x * 1024, limit), -limit)).cast("bigint")).alias("v"))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(1).collect()
    dims = len(first[0]["v"]) if first else parts
    rows = rows.where(F.size("v") == dims)
    start = np.array([r["v"] for r in rows.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(ENTRIES).collect()], np.int64).reshape(-1, dims)
    width = dims // parts
    books = [start[:, k * width : (k + 1) * width].copy() for k in range(parts)]
    fixed = [choose_pivots(b, pivots) if len(b) else b for b in books]

    def vectors(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
        return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)

    def measure(batches):
        for batch in batches:
            x = vectors(batch, "v", dims)
            d = np.concatenate([distances(x[:, k * width : (k + 1) * width], fixed[k]) for k in range(parts)], axis=1)
            ends = np.arange(len(x) + 1, dtype=np.int32) * d.shape[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(d.reshape(-1)))], ["id", "label", "v", "d"])

    held = cut(rows.mapInArrow(measure, "id bigint, label string, v array<bigint>, d array<double>"))
    places = np.cumsum([0, *(len(p) for p in fixed)])

    def assigned(batch: pa.RecordBatch, books: list[np.ndarray]) -> list[tuple]:
        x, d = vectors(batch, "v", dims), vectors(batch, "d", int(places[-1]))
        return [nearest(x[:, k * width : (k + 1) * width], d[:, places[k] : places[k + 1]], books[k], fixed[k]) for k in range(parts)]

    for _ in range(rounds if len(start) else 0):
        shared = spark.sparkContext.broadcast(books)

        def sums(batches, shared=shared):
            total, count = np.zeros((parts, len(start), width), np.int64), np.zeros((parts, len(start)), np.int64)
            for batch in batches:
                x = vectors(batch, "v", dims)
                for k, (index, _, _) in enumerate(assigned(batch, shared.value)):
                    np.add.at(total[k], index, x[:, k * width : (k + 1) * width])
                    count[k] += np.bincount(index, minlength=len(start))
            part, entry = np.nonzero(count)
            place = np.tile(np.arange(width, dtype=np.int32), len(part))
            part, entry = np.repeat(part, width).astype(np.int32), np.repeat(entry, width).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (part, entry, place, total[part, entry, place], count[part, entry])], ["part", "entry", "place", "total", "n"])

        moved = held.select("v", "d").mapInArrow(sums, "part int, entry int, place int, total bigint, n bigint")
        moved = moved.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
        books = [b.copy() for b in books]
        for part, entry, place, total, n in moved:
            books[part][entry, place] = total // n
        shared.unpersist()

    shared = spark.sparkContext.broadcast(books)
    digits = np.array([f"{k:02x}" for k in range(ENTRIES)])

    def code(batches):
        for batch in batches:
            found = assigned(batch, shared.value)
            text = digits[found[0][0]]
            for index, _, _ in found[1:]:
                text = np.char.add(text, digits[index])
            mean = np.full(batch.num_rows, sum(e for *_, e in found) / max(1, batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(text.astype(object), pa.string()), pa.array(sum(e for _, e, _ in found)), pa.array(mean)], ["id", "label", "code", "error", "evaluated"])

    coded = cut(held.mapInArrow(code, "id bigint, label string, code string, error bigint, evaluated double"))
    errors = coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of")
    errors = F.broadcast(errors) if coded.select("label").distinct().limit(max_labels + 1).count() <= max_labels else errors
    digest = hashlib.sha256(",".join(str(int(c)) for b in books for c in b.reshape(-1)).encode()).hexdigest()
    out = coded.join(errors, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"), "evaluated")
