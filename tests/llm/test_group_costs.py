"""What large groups and long texts cost, counted on small ones."""

import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_text_operators import brute_lines
from wavecrest.llm import graph, line_dedup, pieces
from wavecrest.llm.queries import tokenizer_path


def test_components_end_with_their_stars(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(graph, "cut", lambda frame, cut=graph.cut: rounds.append(1) or cut(frame))
    edges = [(0, k) for k in range(1, 40)] + [(100, k) for k in range(101, 120)]
    got = {r.id: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(40)} | {k: 100 for k in range(100, 120)}
    assert len(rounds) == 2  # the edges, and one round


def test_alike_lines_are_confirmed_once_each(spark, monkeypatch):
    draw = random.Random(4)
    base = [f"base{k}" for k in range(60)]
    rows = []
    for doc in range(120):
        line = [w if draw.random() > 0.09 else f"other{draw.randrange(40)}" for w in base]
        rows.append((doc, " ".join(line)))
    asked = []
    monkeypatch.setattr(line_dedup, "confirmed", lambda pairs, docs, t, f=line_dedup.confirmed: asked.append(pairs.count()) or f(pairs, docs, t))
    got = {r.doc_id: r.removed for r in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    sets = [set(text.split()) for _, text in rows]
    assert got == {j: [0] if any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for i in range(j)) else [] for j in range(120)}
    assert len(asked) > 1 and asked[1] < len(rows)  # of lines still open, a pair each


def test_alike_lines_make_no_table_of_pairs(spark, monkeypatch):
    draw = random.Random(5)
    bases = [[f"base{k}" for k in range(60)], [f"long{k}" for k in range(200)]]
    rows = []
    for doc in range(160):
        base = bases[doc % 4 == 3]
        rows.append((doc, " ".join(w if draw.random() > 0.095 else f"other{draw.randrange(40)}" for w in base)))
    made = []
    monkeypatch.setattr(line_dedup, "cut", lambda frame, cut=line_dedup.cut: (out := cut(frame), made.append(out.count()))[0])
    got = {r.doc_id: r.removed for r in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    sets = [set(text.split()) for _, text in rows]
    alike = [[i for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for j in range(160)]
    assert got == {j: [0] if alike[j] else [] for j in range(160)} and sum(map(len, alike)) > 500
    assert max(made[1:]) <= 160  # but for the counts of words, a row a line at most


def test_joins_of_lines_call_no_function_a_pair(spark, monkeypatch):
    """Lines of sizes around the ends of the size classes, each among those of its family that are a little shorter or longer."""
    sizes = [*range(1, 13), *range(22, 34), *range(66, 102, 3)]
    rows = [(doc, " ".join(f"w{doc % 3}x{k}" for k in range(n))) for doc, n in enumerate(random.Random(6).sample(sizes * 3, 3 * len(sizes)))]
    plans = []
    monkeypatch.setattr(line_dedup, "cut", lambda frame, cut=line_dedup.cut: plans.append(frame._jdf.queryExecution().optimizedPlan().toString()) or cut(frame))
    got = {r.doc_id: r.removed for r in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = brute_lines(rows)
    assert got == {doc: want.get(doc, []) for doc, _ in rows} and 0 < len(want) < len(rows)
    joins = [x for plan in plans for x in plan.splitlines() if "Join LeftSemi" in x]
    assert len(joins) >= 3 and not any("lambda" in x for x in joins)  # a function in a join's condition is interpreted for each pair


def test_sizes_that_match_share_a_class(spark):
    for t in (0.5, 0.8, 0.95, 1.0):
        of = {r.n: r.c for r in spark.range(1, 700).selectExpr("int(id) n").select("n", line_dedup.size_classes(F.col("n"), t).alias("c")).collect()}
        assert all(of[m][0] in of[n] for m in of for n in range(1, m + 1) if n >= t * m - 1e-9)
        assert all(len(c) <= 2 for c in of.values()) and not set(of[10]) & set(of[600])


def test_places_where_no_piece_begins_so_are_done():
    model = pieces.Pieces(tokenizer_path("piece_bpe_32k.model"))
    assert sorted(model.tables) == list(range(1, model.longest + 1))
    begins = {k: {b[:k] for b in model.bytes_of if len(b) >= k} for k in (3, 7)}
    for k, (hashes, ids) in model.tables.items():
        assert (np.diff(hashes.view(np.uint64)) > 0).all() if len(hashes) > 1 else True
        assert all(len(model.bytes_of[i]) == k for i in ids[ids >= 0].tolist())
        if k in begins:
            assert len(hashes) <= len(begins[k])
    assert (model.tables[7][1] < 0).any()
    text = " internationalisation 東京都 zzqx".encode()
    data = np.frombuffer(text, np.uint8)
    a, b, token = pieces.Sampler(model)._lattice(data, np.array([0, len(text)]))
    edges = set(zip(a.tolist(), b.tolist(), token.tolist(), strict=True))
    starts = [i for i, x in enumerate(text) if x & 0xC0 != 0x80]
    byte = set(model.byte_ids.tolist())
    want = {(i, i + len(p), k) for k, p in enumerate(model.bytes_of) if p and k not in byte for i in starts if text.startswith(p, i)}
    assert {e for e in edges if e[2] not in byte} == want
