"""What grows with the input: cells of a label, bit tables, samples of repeated rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from wavecrest.llm import embeddings, language, queries
from wavecrest.llm.shared import maybe_in

SF = "/root/testdata/sf0.1"


def test_cells_at_the_parameters_of_the_query(spark, monkeypatch):
    """On the table labels of some 200 vectors have cells, and the links are those of brute force."""
    made = []
    plain = embeddings.spherical_kmeans
    monkeypatch.setattr(embeddings, "spherical_kmeans", lambda sample, cells, **o: made.append(cells) or plain(sample, cells, **o))
    got = {r.vec_id: r for r in queries.op1_kmeans_near_vectors(spark, SF).collect()}
    assert len(made) == 10 and min(made) >= 2
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    links, degree = [], dict.fromkeys(table.vec_id, 0)
    for _, part in table.groupby("label"):
        ids, u = part.vec_id.to_numpy(), embeddings.unit(np.stack(part.embedding))
        for a, b in zip(*np.nonzero(np.triu(u @ u.T >= 0.98, 1)), strict=True):
            links.append((ids[a], ids[b]))
            degree[ids[a]] += 1
            degree[ids[b]] += 1
    root = cases.components(sorted(table.vec_id), links)
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {i: (degree[i], root[i]) for i in degree}


@pytest.mark.parametrize("n", [0, 1, 5_000, 300_000])
def test_bit_tables_follow_their_keys(spark, n):
    keys = spark.range(n).select(F.xxhash64("id").alias("key"))
    there = maybe_in(keys)
    inside, outside = spark.range(n).where(there(F.xxhash64("id"))).count(), spark.range(10**9, 10**9 + 20_000).where(there(F.xxhash64("id"))).count()
    assert inside == n and outside <= 0.14 * 20_000


def test_too_many_keys_have_no_table(spark):
    there = maybe_in(spark.range(3_000).select(F.xxhash64("id").alias("key")), most_bits=1 << 12)
    assert spark.range(100, 5_000_000, 1000).where(there(F.xxhash64("id"))).count() == spark.range(100, 5_000_000, 1000).count()


@pytest.mark.parametrize("one", range(1, 9))
def test_a_language_of_one_id_is_learned(spark, one, monkeypatch):
    """Whatever its hash; and of a text that 20,000 rows repeat one comes to the driver."""
    taught = {}
    monkeypatch.setattr(language, "train", lambda texts, labels, **o: taught.update(texts=texts, labels=labels))
    rows = [(one, "lorem ipsum dolor", "xx")] * 20_000 + [(k, cases.prose(k, 12), "en") for k in range(1000, 1400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").where((language.fold(F.col("doc_id"), 4) != 2) | (F.col("doc_id") == one))
    language.fit(docs, out_fold=5)
    assert taught["labels"].count("xx") == 1 and taught["labels"].count("en") >= 250
