"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products within cells, one representative per group.

Only vectors of one label and length are compared, so each large label has cells of its own. A vector's home is the cell whose centroid it
points to most. If y lies in cell d and x is within distance r of y, where r**2 = 2 - 2 * threshold, then x is at most r beyond the plane between
the centroids of its own cell and of d, and no farther from d's centroid than r and the farthest member of d. A vector is a guest of the
cells after its own that both bounds leave; so chosen they miss no pair, each pair is met once, and the join is exact.

Scale: equal vectors are folded first. Centroids are trained on a bounded sample (``max_sample`` rows) on the driver. A label of n vectors has
sqrt(n / ``rows_per_cell``) cells, ``max_cells`` in all: with cells the comparisons that are spared grow, and so do the guests, for which a square root is a
balance (vectors of no structure: 10 cells of 5,700 vectors spare 0.4 of the comparisons at 3.4 rows a vector). A cell is dealt into blocks of bounded
size by a hash; a task multiplies two blocks at a time and gives one count per vector and no more links than tie components together, so a
crowded cell or label is many small tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecrest.llm.graph import connected_components
from wavecrest.llm.minhash import runs
from wavecrest.llm.shared import cut, drop


def unit(values: np.ndarray) -> np.ndarray:
    values = values.astype(np.float64)
    values = values / np.abs(values).max(axis=-1, keepdims=True)  # so that no square overflows or vanishes
    return values / np.linalg.norm(values, axis=-1, keepdims=True)


def spherical_kmeans(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Unit centroids, (cells, dimensions); a centroid that loses its rows takes the row that fits its own worst."""
    r = np.random.default_rng(seed)
    centroids = sample[r.permutation(len(sample))[:cells]].copy()
    for _ in range(rounds):
        near = np.concatenate([(sample[k : k + 4096] @ centroids.T).argmax(axis=1) for k in range(0, len(sample), 4096)])
        fits = (sample * centroids[near]).sum(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        norm = np.linalg.norm(sums, axis=1)
        empty = np.flatnonzero(norm < 1e-12)
        norm[empty] = 1
        centroids = sums / norm[:, None]
        if len(empty):
            centroids[empty] = sample[np.argsort(fits)[: len(empty)]]
    return centroids


def guests(dots: np.ndarray, home: np.ndarray, centroids: np.ndarray, radius: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (vector, cell) for every later cell than the vector's own that could hold a partner. dots: cosines of vectors with centroids."""
    gaps = np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 0))
    over = dots[np.arange(len(home)), home][:, None] - dots
    near = over <= reach * gaps[home] + 1e-9
    near &= np.sqrt(np.maximum(2 - 2 * dots, 0)) <= radius + reach + 1e-7
    near &= np.arange(len(centroids)) > home[:, None]
    return np.nonzero(near)


def linked_pairs(x: np.ndarray, y: np.ndarray, threshold: float, rows: int = 256) -> np.ndarray:
    """Which rows of x and y have that cosine, some rows at a time."""
    out = np.empty((len(x), len(y)), bool)
    for k in range(0, len(x), rows):
        np.greater_equal(x[k : k + rows] @ y.T, threshold, out=out[k : k + rows])
    return out


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, column) that tie together what ``linked`` ties together: no more than there are rows and columns."""
    rows, columns = np.full(linked.shape[0], -1), np.full(linked.shape[1], -1)
    a, b = [], []
    for start in np.flatnonzero(linked.any(axis=1)):
        if rows[start] >= 0:
            continue
        rows[start] = start
        edge_rows = np.array([start])
        while len(edge_rows):
            found = linked[edge_rows] & (columns < 0)
            new = np.flatnonzero(found.any(axis=0))
            if not len(new):
                break
            a.append(edge_rows[found[:, new].argmax(axis=0)])
            b.append(new)
            columns[new] = start
            back = linked[:, new] & (rows < 0)[:, None]
            edge_rows = np.flatnonzero(back.any(axis=1))
            a.append(edge_rows)
            b.append(new[back[edge_rows].argmax(axis=1)])
            rows[edge_rows] = start
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def near_vectors(
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | None = "label",
    threshold: float = 0.98,
    rows_per_cell: int = 64,
    max_cells: int = 4096,
    max_sample: int = 20_000,
    block: int = 4096,
) -> DataFrame:
    """Returns one row per row of table: id_col, n_links (other rows linked with it directly), component_id (the smallest id that
    can be reached by links, itself included), kept (id = component_id).

    Two rows are linked if their labels are equal and not null and the cosine of their vectors, in double precision, is
    at least ``threshold``. Without label_col all rows are compared. Null, empty and zero vectors, and those that hold null or
    non-finite numbers, are linked with nothing, and so are vectors of different lengths. Rows that repeat an id are rows of their own: they
    count each other as links if their vectors are linked, and each has the component of its own vector. Rows with a null id are linked with nothing and have no component. An empty table gives an empty result.
    Other columns are ignored."""
    spark = table.sparkSession
    label = F.lit("") if label_col is None else F.col(label_col).cast("string")
    vector = F.col(vector_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("bigint").alias("id"), label.alias("label"), vector.alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    sound = F.coalesce(finite, F.lit(False)) & F.col("label").isNotNull()
    v = F.when(sound, F.transform("v", lambda x: x + 0.0))
    # equal vectors of a label are told by 128 bits of hash
    rows = rows.select("id", "label", v.alias("v")).withColumns({"k1": F.xxhash64("label", "v"), "k2": F.xxhash64(F.lit(1), "label", "v")})
    folded = rows.where("v is not null and id is not null").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    folded = cut(folded.withColumns({"dims": F.size("v"), "node": F.monotonically_increasing_id()}))

    # cells of the large labels
    sizes = folded.groupBy("dims", "label").count().where(F.col("count") > rows_per_cell).orderBy(F.desc("count"), "dims", "label").limit(max_cells).collect()
    total = sum(n for *_, n in sizes)
    centroids: dict[tuple[int, str], np.ndarray] = {}
    if sizes:
        listed = spark.createDataFrame([(d, x) for d, x, _ in sizes], "dims int, label string")
        some = folded.join(F.broadcast(listed), ["dims", "label"]).select("dims", "label", "v").orderBy(F.xxhash64("label", "v")).limit(max_sample).toArrow()
        for d, x, n in sizes:
            mine = some.filter(pc.and_(pc.equal(some["dims"], d), pc.equal(some["label"], x)))["v"].combine_chunks()
            cells = min(math.ceil(math.sqrt(n / rows_per_cell)), max_cells * n // total, len(mine))
            if cells > 1:
                centroids[d, x] = spherical_kmeans(unit(mine.flatten().to_numpy().reshape(-1, d)), cells)
    shared = spark.sparkContext.broadcast(centroids)
    reach = (2 - 2 * threshold) ** 0.5

    def by_label(batch):
        """Batches of one length and label, and their unit vectors."""
        dims, label = batch.column("dims").to_numpy(), batch.column("label").dictionary_encode()
        codes = label.indices.to_numpy()
        for d, c in sorted(set(zip(dims.tolist(), codes.tolist(), strict=True))):
            part = batch.filter(pa.array((dims == d) & (codes == c)))
            yield d, label.dictionary[c].as_py(), part, unit(part.column("v").flatten().to_numpy().reshape(-1, d))

    def settle(batches):
        for batch in batches:
            for d, x, part, u in by_label(batch):
                home, far = np.zeros(len(u), np.int32), np.zeros(len(u))
                if (d, x) in shared.value:
                    dots = u @ shared.value[d, x].T
                    home = dots.argmax(axis=1).astype(np.int32)
                    far = np.sqrt(np.maximum(2 - 2 * dots.max(axis=1), 0))
                lists = pa.ListArray.from_arrays(np.arange(len(u) + 1, dtype=np.int32) * d, pa.array(u.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in head), lists, pa.array(home), pa.array(far)], [*head, "v", "cell", "far"])

    head = ["node", "copies", "dims", "label"]
    settled = cut(folded.select(*head, "v").mapInArrow(settle, "node bigint, copies bigint, dims int, label string, v array<double>, cell int, far double"))
    radius = {k: np.zeros(len(c)) for k, c in centroids.items()}
    if centroids:
        for d, x, cell, far in settled.join(F.broadcast(listed), ["dims", "label"]).groupBy("dims", "label", "cell").agg(F.max("far")).collect():
            if (d, x) in radius:
                radius[d, x][cell] = far
    radii = spark.sparkContext.broadcast(radius)

    def visit(batches):
        for batch in batches:
            for d, x, part, u in by_label(batch):
                at, cell = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if (d, x) in shared.value:
                    at, cell = guests(u @ shared.value[d, x].T, part.column("cell").to_numpy(), shared.value[d, x], radii.value[d, x], reach)
                rows = part.select([*head, "v"]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cell.astype(np.int32)), pa.array(np.ones(len(at), bool))], [*head, "v", "cell", "guest"])

    homes = settled.select(*head, "v", "cell", F.lit(False).alias("guest"))
    placed = homes.unionAll(settled.drop("far").mapInArrow(visit, homes.schema)) if centroids else homes
    group = ["dims", "label", "cell"]
    blocks = placed.groupBy(*group).agg(F.ceil(F.count_if(~F.col("guest")) / block).cast("int").alias("hb"), F.ceil(F.count_if("guest") / block).cast("int").alias("gb")).where("hb > 0")
    # blocks of a cell are numbered, guests behind homes; each pair of a block of homes and another block, or itself, is met once
    members = placed.join(blocks, group).withColumn("mine", F.when(F.col("guest"), F.col("hb") + F.pmod(F.xxhash64("node"), "gb")).otherwise(F.pmod(F.xxhash64("node"), "hb")).cast("int"))
    others = F.sequence(F.lit(0), F.when(F.col("guest"), F.col("hb") - 1).otherwise(F.col("hb") + F.col("gb") - 1))
    members = members.withColumn("other", F.explode(others)).withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")})

    def compare(batches):
        for group_rows in runs(batches, keys):
            mine, node, copies = (group_rows.column(c).to_numpy() for c in ("mine", "node", "copies"))
            d, i, j = (group_rows.column(c)[0].as_py() for c in ("dims", "i", "j"))
            u = group_rows.column("v").combine_chunks().flatten().to_numpy().reshape(-1, d)
            p, q = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
            if not len(p) or not len(q):
                continue
            linked = linked_pairs(u[p], u[q], threshold)
            if i == j:
                np.fill_diagonal(linked, False)
            n = np.zeros(len(node), np.int64)
            n[p] = linked @ copies[q]
            if i != j:
                n[q] = copies[p] @ linked
            r, c = forest(linked)
            some = np.flatnonzero(n)
            a = np.concatenate([node[some], node[p][r]])
            b = np.concatenate([np.full(len(some), -1), node[q][c]])
            count = np.concatenate([n[some], np.zeros(len(r), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=np.arange(len(b)) < len(some)), pa.array(count)], ["a", "b", "n"])

    keys = [*group, "i", "j"]
    pairs = members.select(*keys, "mine", "node", "copies", "v").repartition(*keys).sortWithinPartitions(*keys)
    found = cut(pairs.mapInArrow(compare, "a bigint, b bigint, n bigint"))
    drop(settled)
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("id", "node")
    nodes = folded.select("k1", "k2", "node", "copies", "id").join(counts, "node", "left").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    nodes = cut(nodes)
    drop(found, folded)
    least = nodes.groupBy("component").agg(F.min("id").alias("least"))
    nodes = nodes.join(least, "component").select("k1", "k2", "copies", "n", "least")
    out = rows.select("id", F.when(F.col("v").isNotNull() & F.col("id").isNotNull(), F.col("k1")).alias("k1"), "k2").join(nodes, ["k1", "k2"], "left")
    links = F.coalesce(F.col("copies") - 1 + F.coalesce("n", F.lit(0)), F.lit(0))
    component = F.coalesce("least", "id")
    return out.select(F.col("id").alias(id_col), links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
