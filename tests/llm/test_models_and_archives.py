import base64
import gzip
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from wavecrest.llm import embeddings, graph, language, toxicity, warc

SF = "/root/testdata/sf0.01"


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(5, 5), (7, None), (200, 201), (201, 200), (139, 300)]
    got = {r.id: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    ids = {x for e in edges for x in e if None not in e and e[0] != e[1]}
    want = cases.components(sorted(ids), [e for e in edges if None not in e])
    assert got == want


VECTORS = "vec_id bigint, embedding array<float>, label int, id string, key string, n string, u string"


def test_near_vectors(spark):
    r = np.random.default_rng(0)
    base = r.normal(size=(40, 8))
    rows, vectors = [], []
    for k in range(400):
        v = (base[k % 40] + r.normal(size=8) * [0.0, 0.05, 0.3, 1.0][k % 4]).astype(np.float32) * (1 + k % 3)
        rows.append((k, v.tolist(), [None, 1, 2][k % 3]))
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 8, 1), (1003, [float("nan")] + [1.0] * 7, 1), (1004, [None] + [1.0] * 7, 1), (1005, [float("inf")] * 8, 1), (1006, [1.0, 2.0], 1), (1007, [2.0, 4.0], 1)]
    rows += [(2000 + k, rows[1][1], 1) for k in range(30)]
    got = embeddings.near_vectors(spark.createDataFrame([(*x, "a", "b", "c", "d") for x in rows], VECTORS), rows_per_cell=40, block=16).collect()
    assert len(got) == len(rows)
    good = {}
    for i, v, label in rows:
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            good[i] = (label, x / np.linalg.norm(x))
    ids = sorted(good)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= 0.98]
    n = dict.fromkeys((x[0] for x in rows), 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    want = cases.components([x[0] for x in rows], links)
    for x in got:
        assert (x.n_links, x.component_id, x.kept) == (n[x.vec_id], want[x.vec_id], want[x.vec_id] == x.vec_id)
    assert embeddings.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_repeated_vector_ids(spark):
    near = [[1.0, 0.01 * k, 0.0] for k in range(4)]
    rows = [(1, near[0], 1), (1, near[1], 1), (2, near[2], 1), (3, near[3], 1), (3, [0.0, 0.0, 1.0], 1), (7, [0.0, 0.0, 2.0], 2), (None, near[0], 1)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=repr) == sorted(
        [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (3, 0, 3, True), (7, 0, 7, True), (None, 0, None, True)], key=repr
    )


PAGES = "page_id bigint, url string, html string, file string, __id string, payload string"


def test_archives(spark, tmp_path):
    texts = [None, "", "same", "same", "same", "größer\r\n\r\nWARC/1.1\r\n", "x" * 3_000_000, "single", "same"]
    rows = [(k * 7 % 23, None if k == 3 else f"http://h/{k}\n", t, "a", "b", "c") for k, t in enumerate(texts)]
    pages = spark.createDataFrame(rows, PAGES).repartition(2)
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w", file_bytes=1000)
    records = warc.read_archives(manifest)
    got = {r.page_id: r for r in warc.resolve_revisits(records).collect()}
    assert len(got) == len(rows)
    for i, _, t, *_ in rows:
        data = (t or "").encode()
        alike = [r[0] for r in rows if (r[2] or "") == (t or "")]
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if max(alike) == i else ("revisit", max(alike)))
    files = [r.file.removeprefix("file://") for r in manifest.collect()]
    assert len(files) > 1 and records.rdd.getNumPartitions() == len(files)
    busy = records.groupBy(F.input_file_name(), F.spark_partition_id()).count().count()
    assert busy == len(files)
    whole = b"".join(gzip.decompress(open(f, "rb").read()) for f in files)
    assert whole.count(b"WARC/1.1\r\nWARC-Type: ") == len(rows) and sum(r.n_records for r in manifest.collect()) == len(rows)
    assert {r.payload for r in records.where("record_type = 'revisit'").collect()} == {b""}
    small = warc.deduplicated(pages, min_bytes=10).collect()
    assert all(r.record_type == "response" for r in small)
    assert warc.deduplicated(spark.createDataFrame([], PAGES)).count() == 0


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    found = toxicity.score(docs, model).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (found.held_out == [fold(i, 5) == 0 for i in found.doc_id]).all() and found.score.between(0, 1).all()
    held = found[found.held_out]
    # some 30 toxic texts to learn from: few are found yet, but clean ones are left alone
    assert ((held.toxic == 1) == (held.predicted == 1)).mean() > 0.9 and (held[held.toxic == 0].predicted == 1).mean() < 0.05
    edge = toxicity.score(cases.frame(spark, cases.documents()), model).collect()
    assert len(edge) == len(cases.documents()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in edge)
    assert toxicity.score(cases.empty(spark), model).count() == 0
    marks = spark.createDataFrame([(13, 1)], "doc_id bigint, toxic int")
    assert toxicity.score(cases.frame(spark, cases.documents()), toxicity.fit(cases.frame(spark, cases.documents()), marks)).count() == len(cases.documents())


def test_toxic_texts_are_found(spark):
    sf = SF.replace("0.01", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels.select("doc_id", "toxic"), "doc_id").toPandas()
    held = found[found.held_out]
    assert (held.toxic == 1).sum() > 20
    assert (held[held.toxic == 1].predicted == 1).mean() > 0.6 and (held[held.toxic == 0].predicted == 1).mean() < 0.03


def test_network_gradient():
    r = np.random.default_rng(1)
    model = toxicity.Model(buckets=64, size=4, filters=4, seed=2)
    for p in (*model.kernels, model.bias, model.weight, model.table[1:]):
        p += r.normal(0, 0.5, p.shape).astype(np.float32)
    made = toxicity.Texts(["one two three four", "five six", "seven eight nine ten eleven"], lower=True)
    padded, starts = model.padded(*toxicity.word_rows(made, model.buckets))
    y = np.array([1, 0, 1])

    def loss():
        top = np.maximum(np.maximum.reduceat(model.maps(padded), starts, axis=0) + model.bias, 0)
        z = (top @ model.weight + model.offset).astype(np.float64)
        return np.mean(np.log1p(np.exp(z)) - y * z) + 5e-5 * float((model.weight.astype(np.float64) ** 2).sum())

    dense, rows, of_rows, of_offset = model.gradients(padded, starts, y)
    table = np.zeros_like(model.table)
    table[rows] = of_rows
    table[toxicity.PAD] = 0
    for p, g in zip([*model.kernels, model.bias, model.weight, model.table[1:]], [*dense, table[1:]], strict=True):
        flat, of = p.reshape(-1), g.reshape(-1)
        for k in r.permutation(len(flat))[:12].tolist() + np.argsort(-np.abs(of))[:6].tolist():
            old = flat[k]
            flat[k] = old + 1e-3
            up = loss()
            flat[k] = old - 1e-3
            down = loss()
            flat[k] = old
            assert (up - down) / 2e-3 == pytest.approx(of[k], abs=3e-4, rel=0.02)


def test_network_learns_a_word():
    texts = [f"fine words only {k}" if k % 2 else f"fine badword only {k}" for k in range(60)]
    model = toxicity.train(texts, [1 - k % 2 for k in range(60)], ["xx"] * 60, (30, 30))
    made = toxicity.Texts(["a badword here", "a fine word here"], lower=True)
    z = model.logits(*toxicity.word_rows(made, model.buckets))
    assert z[0] > z[1]


def brute_marginals(emission, transition):
    n, k = emission.shape
    total, out = 0.0, np.zeros((n, k))
    for path in np.ndindex(*(k,) * n):
        w = np.exp(sum(emission[t, y] for t, y in enumerate(path)) + sum(transition[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += w
        for t, y in enumerate(path):
            out[t, y] += w
    return out / total


def test_forward_backward():
    r = np.random.default_rng(3)
    emission, transition = r.normal(size=(9, 3)), r.normal(size=(3, 3))
    first = np.array([0, 4, 5, 9])
    got, expected = language.forward_backward(emission, transition, first)
    for a, b in zip(first, first[1:], strict=False):
        assert np.allclose(got[a:b], brute_marginals(emission[a:b], transition))
    assert expected.sum() == pytest.approx(6)


def test_field_gradient():
    r = np.random.default_rng(4)
    model = language.Field(["a", "b", "c"], buckets=128)
    chains = language.Chains(["one two three", "four five", "one"])
    model.lexicons = [np.sort(chains.words[k::3]) for k in range(3)]
    model.weights = r.normal(0, 0.3, model.weights.shape)
    model.of_lexicon, model.transition = r.normal(size=(3, 3)), r.normal(size=(3, 3))
    y = np.array([0, 1, 2, 2, 0, 1])

    def likelihood():
        e, total = model.emissions(chains)[chains.which], 0.0
        for a, b in zip(chains.first, chains.first[1:], strict=False):
            score = lambda path, a=a: sum(e[a + t, k] for t, k in enumerate(path)) + sum(model.transition[p, q] for p, q in zip(path, path[1:], strict=False))
            total += score(tuple(y[a:b])) - np.log(sum(np.exp(score(path)) for path in np.ndindex(*(3,) * int(b - a))))
        return total

    for p, g in zip((model.weights, model.of_lexicon, model.transition), model.gradients(chains, y), strict=True):
        flat, of = p.reshape(-1), g.reshape(-1)
        for k in r.permutation(len(flat))[:15].tolist() + np.argsort(-np.abs(of))[:5].tolist():
            old = flat[k]
            flat[k] = old + 1e-4
            up = likelihood()
            flat[k] = old - 1e-4
            down = likelihood()
            flat[k] = old
            assert (up - down) / 2e-4 == pytest.approx(of[k], abs=1e-4)


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs, max_rows=60)
    found = language.label(docs, model).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (found.held_out == [fold(i, 4) == 2 for i in found.doc_id]).all() and found.score.between(0, 1).all()
    held = found[found.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97
    texts = {r.lang: r.text.split("\n")[0] for r in docs.where("lang in ('en', 'de')").limit(200).collect()}
    mixed = spark.createDataFrame([(1, texts["en"] + "\n" + texts["de"])], "doc_id bigint, text string")
    spans = language.label(mixed, model, spans=True).first().spans
    assert {s.lang for s in spans} >= {"en", "de"}
    edge = {r.doc_id: r for r in language.label(cases.frame(spark, cases.documents()), model).collect()}
    for i, t, *_ in cases.documents():
        if i is not None:
            assert (edge[i].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
    assert language.label(cases.empty(spark), language.fit(cases.empty(spark))).count() == 0
    assert {r.lang_pred for r in language.label(cases.frame(spark, cases.documents()), None).collect()} == {"und"}
