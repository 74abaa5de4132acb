"""Exact copies against SQL and brute force, vector codes against brute force, repaired conversations against every possible repair."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from tests.compare import connect, rows
from tests.llm.cases import documents, empty, frame
from wavecrest.llm import conversations, exact_dedup, queries, vector_codes

SF = "/root/testdata/sf0.001"
BLANK = re.compile(r"[\x20\x09-\x0D]+")


def brute_copies(docs):
    groups = {}
    for k, (i, text, *_) in enumerate(docs):
        plain = BLANK.sub("", text or "")
        groups.setdefault(plain, []).append((-len(text or ""), i is None, i or 0, k))
    out = []
    for k, (i, text, *_) in enumerate(docs):
        plain = BLANK.sub("", text or "")
        keep = docs[min(groups[plain])[3]][0]
        out.append((i, keep, len(groups[plain]), hashlib.sha256(plain.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("partitions, fan_in", [(1, 2), (7, 2), (40, 4), (40, 16)])
def test_exact_copies(spark, partitions, fan_in):
    docs = documents() + [(500 + k, "same  words\n" + " " * (k % 5), "en", "s1", 1) for k in range(60)] + [(9_000, "long " * 400_000, "en", "s1", 1), (8_999, "long" * 400_000 + "\t", "en", "s1", 1)]
    got = exact_dedup.exact_duplicates(frame(spark, docs, partitions), fan_in=fan_in).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute_copies(docs)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_copies_of_nothing(spark):
    assert exact_dedup.exact_duplicates(empty(spark)).collect() == []
    with pytest.raises(ValueError):
        exact_dedup.exact_duplicates(empty(spark), fan_in=3)


def test_exact_copies_match_sql(spark):
    got = queries.op13_digest_run_tree(spark, SF)
    want = connect(SF).execute(queries.ORACLES["op13_digest_run_tree"]).df()
    assert rows(got.toPandas()) == rows(want)


def test_exact_copies_run_no_python(spark):
    plan = exact_dedup.exact_duplicates(frame(spark, documents()))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def brute_codes(table, parts=4, rounds=4):
    kept = [(i, label, [int(np.floor(1024 * x)) for x in v]) for i, v, label in table if v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    x = np.array([v for *_, v in kept])
    width = x.shape[1] // parts
    books, codes, errors = [], [], np.zeros(len(x), np.int64)
    for k in range(parts):
        p = x[:, k * width : (k + 1) * width]
        book = [list(r) for r in p[:256]]
        for step in range(rounds + 1):
            d = ((p[:, None, :] - np.array(book)[None]) ** 2).sum(axis=2)  # every part with every entry
            near = d.argmin(axis=1).tolist()
            if step < rounds:
                for j in set(near):
                    mine = [p[i].tolist() for i in range(len(p)) if near[i] == j]
                    book[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
        codes.append(near)
        errors += d.min(axis=1)
        books.append(book)
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    by_label = {}
    for (_, label, _), e in zip(kept, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + int(e)
    return sorted(((i, "".join(f"{c[k]:02x}" for c in codes), int(errors[k]), by_label[label], digest) for k, (i, label, _) in enumerate(kept)), key=repr)


def vectors(n, seed=1, dims=8):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(12, dims))
    return [(k * 7 % 1000 + 3, (centre[k % 12] + 0.05 * r.normal(size=dims)).round(4).tolist(), [None, 1, 2, 1][k % 4]) for k in range(n)]


def coded(spark, table, **options):
    got = vector_codes.compress(spark.createDataFrame(table, "vec_id bigint, embedding array<double>, label int, id string, code string").repartition(3), **options)
    return got, sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect()), key=repr)


@pytest.mark.parametrize("max_labels", [10_000, 1])
def test_vector_codes(spark, max_labels):
    table = vectors(400) + [(None, [0.5] * 8, 1), (5000, None, 1), (5001, [1.0, None] * 4, 1), (5002, [float("nan")] * 8, 2), (5003, [float("inf")] * 8, 2), (5004, [1e30] * 7, 2), (5005, [], 1)]
    table += [(10, [-0.0, 0.0, -1e-9, 1e-9] * 2, 1)] * 2 + [(6000 + k, [0.25] * 8, None) for k in range(100)]
    _, got = coded(spark, [(*r, "x", "y") for r in table], max_labels=max_labels)
    assert got == brute_codes([r for r in table if r[0] != 5004])


def test_vector_codes_of_few_and_of_large(spark):
    few = vectors(5)
    assert coded(spark, [(*r, "x", "y") for r in few])[1] == brute_codes(few)
    assert coded(spark, [])[1] == [] and coded(spark, [(1, None, 2, "x", "y")])[1] == []
    big = coded(spark, [(1, [1e300] * 8, 1, "x", "y"), (2, [-1e300] * 8, 1, "x", "y"), (3, [0.0] * 8, 1, "x", "y")])[1]
    assert [r[2] for r in big] == [0, 0, 0]


def test_vector_codes_skip_most_distances(spark):
    """On vectors that form groups most entries are pruned, and none wrongly."""
    got, _ = coded(spark, [(*r, "x", "y") for r in vectors(900, dims=32)])
    assert got.selectExpr("avg(evaluated)").first()[0] < 0.5 * 4 * 256


def test_vector_codes_of_the_table(spark):
    table = connect(SF).execute("SELECT vec_id, embedding, label FROM embeddings").fetchall()
    got = queries.op12_laesa_codes(spark, SF).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got), key=repr) == brute_codes([(i, list(v), label) for i, v, label in table])


def damage(table):
    out = {}
    for conv, turn, role, text in table:
        mine = out.setdefault(conv, [])
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        mine += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def told(mine):
    seen, kinds = set(), []
    for _, role, text in mine:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return kinds


def every_repair(mine, kinds):
    """(cost, audit, turns) of each sequence of edits with at most two turns inserted in a place."""
    inserts = [""] + ["u", "a", "ua", "au", "uu", "aa"]
    names = {"u": "user", "a": "assistant"}
    choices = []
    for (_, role, text), kind in zip(mine, kinds, strict=True):
        mend = 3 if kind == "truncated" else 0
        edits = [(4, "D", None)]
        if kind not in ("blank", "duplicate"):
            edits += [(mend, "K", (role, text)), (3 + mend, "R", ("user", text)), (3 + mend, "R", ("assistant", text))]
        choices += [[(3 * len(i), "I" * len(i), [(names[c], "") for c in i]) for i in inserts], [(c, e, [t] if t else []) for c, e, t in edits]]
    choices.append([(3 * len(i), "I" * len(i), [(names[c], "") for c in i]) for i in inserts])
    best = None
    for path in itertools.product(*choices):
        turns = [t for p in path for t in p[2]]
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in turns)):
            best = min(best or (10**9,), (sum(p[0] for p in path), "".join(p[1] for p in path), turns))
    return best


def cheapest(mine, kinds):
    """The same by a plain search from the left: all (cost, audit) of each state, the least kept."""
    here = {0: (0, "", [])}
    moves = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}

    def insert(states):
        for _ in range(3):
            for s, (c, a, t) in list(states.items()):
                for letter, name in (("u", "user"), ("a", "assistant")):
                    if s in moves[letter]:
                        to, new = moves[letter][s], (c + 3, a + "I", [*t, (name, "")])
                        states[to] = min(states.get(to, new), new)
        return states

    for (_, role, text), kind in zip(mine, kinds, strict=True):
        after = {}
        for s, (c, a, t) in insert(here).items():
            options = [(s, (c + 4, a + "D", t))]
            mend = 3 if kind == "truncated" else 0
            if kind not in ("blank", "duplicate"):
                options += [(moves[role[:1]][s], (c + mend, a + "K", [*t, (role, text)]))] if s in moves.get(role[:1], {}) else []
                options += [(moves[n[0]][s], (c + 3 + mend, a + "R", [*t, (n, text)])) for n in ("user", "assistant") if s in moves[n[0]]]
            for to, new in options:
                after[to] = min(after.get(to, new), new)
        here = after
    return min(v for s, v in insert(here).items() if s in (0, 3))


def brute_conversations(table, repair, order=None):
    out = []
    for conv, mine in damage(table).items():
        mine = sorted(mine, key=order or (lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])))
        kinds = told(mine)
        turns = [t for t, *_ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit, fixed = repair(mine, kinds)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out.append((conv, gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def repaired(spark, table, partitions=3):
    schema = "conv_id bigint, turn bigint, role string, text string, pos string, kind string, costs string, block string, fault string"
    got = conversations.repair_conversations(spark.createDataFrame([(*r, "x", "y", "z", "1", "2") for r in table], schema).repartition(partitions))
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert got.columns == names
    return sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr)


def talk(conv, n, seed):
    r = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "No!", "and then", " \n ", "", None, "Why? ", "é。"]
    return [(conv, t, r.choice(roles[: 5 + 3 * (seed % 2)]), r.choice(texts) if r.random() < 0.5 else f"Turn {r.randrange(30)}." + " " * r.randrange(2)) for t in range(n)]


def test_repair_against_every_repair(spark):
    table = [row for k in range(90) for row in talk(k, k % 3, k)]
    table += [row for k in range(100, 120) for row in talk(k, 3, k)]
    assert max(len(mine) for mine in damage(table).values()) <= 4
    assert repaired(spark, table) == brute_conversations(table, every_repair)


def test_repair_of_long_and_odd_conversations(spark):
    table = [row for k in range(60) for row in talk(k, 1 + k % 9, 100 + k)]
    table += [row for k, n in ((900, 64), (901, 65), (902, 128), (903, 700), (904, 5000)) for row in talk(k, n, k)]
    table += [(None, k, "user", f"Who? {k}.") for k in range(3)] + [(905, None, "assistant", "So."), (905, 7, "user", "x" * 3_000_000 + "."), (905, None, "user", "Hm?")]
    table += [(c, t, r, "Same.") for c in range(2000, 2100) for t, r in ((0, "user"), (1, "assistant"))] + [(906, 3, "user", "Again.")]
    got = repaired(spark, table, 5)
    # the rows of a null turn are in order of their roles
    assert got == brute_conversations(table, cheapest)
    assert repaired(spark, []) == []


def test_repair_of_repeated_turns(spark):
    table = [(1, 2, "user", "One."), (1, 2, "user", "One."), (1, 2, "assistant", "Two."), (1, 5, "user", "Three.")] * 2
    assert repaired(spark, table) == brute_conversations(table, cheapest)


def test_repaired_turns(spark):
    table = spark.createDataFrame([("1", 0, "system", "Be kind."), ("1", 1, "assistant", "Hello."), ("2", 0, "tool", "x")], "conv string, turn bigint, role string, text string")
    got = [tuple(r) for r in conversations.repaired_turns(table).orderBy("conv", "place").collect()]
    assert got == [("1", 0, "K", "system", "Be kind."), ("1", 1, "I", "user", ""), ("1", 2, "K", "assistant", "Hello.")]


def test_repair_of_the_table(spark):
    table = connect(SF).execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    got = queries.op11_suffix_automaton_repair(spark, SF).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_conversations(table, cheapest)


def test_a_node_is_met_once(spark, monkeypatch):
    """Signatures that end alike share their nodes."""
    import pyarrow as pa

    met = []
    plain = conversations.before
    monkeypatch.setattr(conversations, "before", lambda node, letter: met.append(letter) or plain(node, letter))
    words = sorted("".join(w)[::-1] for n in range(1, 6) for w in itertools.product("uad", repeat=n))
    batch = pa.RecordBatch.from_pydict({"conv": words, "block": [0] * len(words), "last": [True] * len(words), "behind": [[0, 6, 3, 0]] * len(words), "reversed": words})
    out = pa.Table.from_batches(conversations.planned(iter([batch])))
    assert len(met) == len(words) == out.num_rows
