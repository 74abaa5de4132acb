import re

import corpus_pipeline
from tests.llm import cases
from tests.llm.test_text_operators import brute_lines, shingles
from wavecrest.llm.shared import cut

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, columns, out = docs.toPandas(), docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF))
        out[name] = docs.toPandas()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    toxic = set(spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").toPandas().doc_id)
    left = set(out["toxicity"].doc_id)
    assert len(left) > 0.7 * len(before) and len(toxic & left) <= 0.3 * len(toxic)
    lines = out["line dedup"]
    removed = brute_lines(list(zip(out["toxicity"].doc_id, out["toxicity"].text, strict=True)))
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in removed.get(i, [])) for i, t in zip(out["toxicity"].doc_id, out["toxicity"].text, strict=True)}
    assert all(want[i] == t and n == len(t) for i, t, n in zip(lines.doc_id, lines.text, lines.n_chars, strict=True))
    assert all(not want[i].strip() for i in left - set(lines.doc_id))
    sets = [(i, shingles(t)) for i, t in zip(lines.doc_id, lines.text, strict=True)]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    root = cases.components([i for i, _ in sets], links)
    assert set(out["near dedup"].doc_id) == {i for i in root if root[i] == i}
    copies = out["mixing"].groupby("doc_id").size()
    assert set(copies.index) <= set(out["near dedup"].doc_id) and copies.max() <= 3
    assert len(out["sampled pieces"]) == len(out["mixing"])
    words = lambda f: sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in f.text)
    assert abs(words(out["mixing"]) / words(out["near dedup"]) - 1) < 0.15


def test_edge_cases_run_through(spark):
    nulls = sum(r[1] is None for r in cases.documents())
    for docs, empty in ((cases.frame(spark, cases.documents()), False), (cases.empty(spark), True)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = cut(stage(spark, docs, SF))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == columns
            assert (docs.count() == 0) == empty
            if not empty and name in ("toxicity", "line dedup"):
                assert docs.where("text is null").count() == nulls > 0


def test_near_copies_from_080(spark):
    words = cases.prose(7, 204).split()
    four = " ".join(f"new{k}" if k in (20, 60, 100, 140) else w for k, w in enumerate(words))
    five = " ".join(f"new{k}" if k in (20, 60, 100, 140, 180) else w for k, w in enumerate(words))
    base = " ".join(words)
    similar = lambda a, b: len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    assert 0.80 <= similar(base, four) < 0.85 and similar(base, five) < 0.80
    rows = [(1, base, "en", "s1", 1), (2, four, "en", "s1", 1), (4, base + " other ending", "en", "s1", 1)]
    far = cases.prose(8, 100)
    rows += [(5, far, "en", "s2", 2), (5, far, "en", "s2", 2), (5, far, "en", "s1", 2), (5, cases.prose(9, 100), "en", "s2", 2), (6, None, "en", "s2", 0), (6, None, "en", "s2", 0)]
    rows += [(7, five.replace("alpha", "x"), "en", "s1", 1), (None, base, "en", "s1", 1), (None, base, "en", "s1", 1)]
    out = corpus_pipeline.drop_near_copies(spark, cases.frame(spark, rows), SF)
    got = sorted(((r.doc_id, r.text, r.source) for r in out.collect()), key=repr)
    want = [(1, base, "s1"), (5, far, "s1"), (5, rows[6][1], "s2"), (6, None, "s2"), (7, rows[9][1], "s1"), (None, base, "s1"), (None, base, "s1")]
    assert got == sorted(want, key=repr)


def test_columns_of_any_type(spark):
    rows = [r[:5] for r in cases.documents()]
    docs = cases.frame(spark, [*rows, rows[20], rows[20]]).selectExpr("doc_id", "text", "lang", "source", "n_chars", "map('a', n_chars, 'b', doc_id) AS m", "array(lang, source) AS names", "named_struct('m', map(1, lang)) AS deep", "cast(lang AS binary) AS raw")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = cut(stage(spark, docs, SF))
        assert docs.columns == columns and docs.count() > 0, name
