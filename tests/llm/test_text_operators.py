import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import cases
from wavecrest.llm import line_dedup, line_quality, minhash, mixing, pieces, token_planes
from wavecrest.llm.queries import tokenizer_path
from wavecrest.llm.words import Texts, chunks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = cases.documents()
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def test_words_are_those_of_the_pattern():
    texts = [r[1] for r in DOCS] + ["x" * 5000, "\u0085a b", "\x1ca b"]
    words = Texts(texts).words()
    data = words.texts.data.tobytes()
    for i, t in enumerate(texts):
        got = [data[a:b].decode() for a, b in zip(words.starts[words.first[i] : words.first[i + 1]], words.ends[words.first[i] : words.first[i + 1]], strict=True)]
        assert got == WORD.findall(t or "")
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["t"])
    assert sum(p.num_rows for p in chunks(batch, "t", 100)) == len(texts)


def shingles(text, size=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def test_near_duplicates(spark):
    got = minhash.near_duplicates(cases.frame(spark, DOCS), block=8).collect()
    sets = [(r[0], shingles(r[1])) for r in DOCS if r[0] is not None]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and 100 * len(x & y) >= 85 * len(x | y)]
    want = cases.components([i for i, _ in sets], links)
    size = dict(sets)
    assert len(got) == len(DOCS)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], len(size[r.doc_id]), want[r.doc_id] == r.doc_id)
    assert max(Counter(want.values()).values()) > 8
    assert minhash.near_duplicates(cases.empty(spark)).count() == 0


def test_line_quality(spark):
    rows = DOCS + [(1000 + k, f"Shared Line, no {k:02d} of all\n" + cases.prose(500 + k, 30), "en", "host", 1) for k in range(30)]
    rows += [(2000 + k, "\n".join(f"boiler plate line of words number {j}" for j in range(6)) + f"\nonly {k}", "en", "host", 1) for k in range(20)]
    found = line_quality.line_quality(cases.frame(spark, rows)).collect()
    assert len(found) == len(rows)
    got = {r.doc_id: r for r in found}
    for i, t, *_ in rows:
        if i is None:
            continue
        t = t or ""
        w = WORD.findall(t)
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        if i < 1000:
            assert r.kept == (not want[-1])
        elif i < 2000:
            assert r.kept and r.lost_lines == 1  # digits fold together, so the shared line is one
        else:
            assert not r.kept and r.lost_words > 0.5 * r.n_words
    assert line_quality.line_quality(cases.empty(spark)).count() == 0


def brute_frequent(rows, least):
    """Hosts and normalised lines that more than ``least`` distinct ids hold."""
    held = defaultdict(set)
    for i, t, _, host, *_ in rows:
        for line in (t or "").split("\n"):
            held[host, normal(line)].add(i)
    return {k for k, ids in held.items() if k[1] and len(ids) > least}


def normal(line):
    return re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", "", re.sub("[0-9]", "0", line.translate(LOWER))) if WORD.search(line) else ""


def test_frequent_lines_are_removed_from_texts(spark):
    rows = DOCS + [(1000 + k, f"Shared Line, no {k:02d} of all\n\n" + cases.prose(500 + k, 30) + "\n--\nshared line (no 00) of ALL!" * (k % 3), "en", ["host", None][k % 2], 1) for k in range(30)]
    rows += [(2000 + k, "\n".join(f"boiler plate line of words number {j}" for j in range(6)) + f"\nonly {k}\n", "en", "host", 1) for k in range(20)]
    rows += [(1000, "boiler plate line of words number 1\nanother text of a repeated id", "en", "host", 1), (None, "shared line no 77 of all\nnull id", "en", "host", 1)]
    rows += [(3000, "shared line no 77 of all\nother host", "en", "s1", 1)]
    frequent = brute_frequent(rows, 10)
    want = []
    for i, t, _, host, *_ in rows:
        lines = (t or "").split("\n")
        gone = [k for k, x in enumerate(lines) if (host, normal(x)) in frequent]
        text = None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
        want.append((i, gone, text, len({normal(lines[k]) for k in gone}), sum(len(WORD.findall(lines[k])) for k in gone)))
    out = line_quality.clean_texts(cases.frame(spark, rows)).collect()
    assert sorted(((r.doc_id, list(r.removed), r.text, r.lost_lines, r.lost_words) for r in out), key=repr) == sorted(want, key=repr)
    assert sum(len(w[1]) for w in want) > 150
    sums = line_quality.line_quality(cases.frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.text_crc32) for r in sums), key=repr) == sorted(((w[0], None if w[2] is None else zlib.crc32(w[2].encode())) for w in want), key=repr)
    assert line_quality.clean_texts(cases.empty(spark)).count() == 0


def test_line_limit_is_the_same_for_hosts_of_any_size(spark):
    passage = "a passage that a dozen documents of this host hold"
    rows = [(k, (passage if k % 250 == 0 else cases.prose(k, 8)) + "\n" + cases.prose(5000 + k, 30), "en", "hot", 1) for k in range(3000)]
    rows += [(10000 + k, passage + "\n" + cases.prose(9000 + k, 30), "en", "small", 1) for k in range(11)]
    rows += [(20000 + k, passage + "\n" + cases.prose(9500 + k, 30), "en", "rare", 1) for k in range(10)]
    got = {r.doc_id: r for r in line_quality.clean_texts(cases.frame(spark, rows)).collect()}
    for i, t, *_ in rows:
        held = t.startswith(passage) and i < 20000
        assert (0 in got[i].removed) == held and (passage in got[i].text) == (t.startswith(passage) and not held)


def brute_lines(rows, t=0.8):
    lines = [(i, k, frozenset(x for x in re.split("[ \t\x0b\x0c\r]+", line.lower()) if x)) for i, text in rows for k, line in enumerate(text.split("\n"))]
    lines = sorted((x for x in lines if x[2]), key=lambda x: x[:2])
    removed = defaultdict(list)
    for a, (i, k, s) in enumerate(lines):
        if any(len(s & u) >= t * len(s | u) - 1e-9 for _, _, u in lines[:a]):
            removed[i].append(k)
    return removed


def test_line_dedup(spark):
    rows = [r for r in DOCS if r[1] is None or len(r[1]) < 20000]
    known = {r[0]: r[1] for r in rows if r[0] is not None and r[1] is not None}
    want = brute_lines(known.items())
    found = line_dedup.removed_lines(cases.frame(spark, rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert list(r.removed) == ([] if r.doc_id is None else want.get(r.doc_id, []))
    assert sum(map(len, want.values())) > 100
    cleaned = cases.frame(spark, rows)
    out = line_dedup.clean_documents(cleaned)
    assert out.columns == cleaned.columns
    got = {r.doc_id: r.text for r in out.collect()}
    for i, text in known.items():
        lines = text.split("\n")
        left = [x for k, x in enumerate(lines) if k not in want.get(i, [])]
        full = [k for k, x in enumerate(lines) if x.strip(" \t\x0b\x0c\r")]
        if full and set(full) <= set(want.get(i, [])):
            assert i not in got
        else:
            assert got[i] == "\n".join(left)
    assert None in got and line_dedup.removed_lines(cases.empty(spark)).count() == 0 and line_dedup.clean_documents(cases.empty(spark)).count() == 0


def test_alike_lines_behind_common_words(spark):
    r = np.random.default_rng(8)
    passage = cases.prose(1, 40)
    word = lambda: "".join(chr(97 + c) for c in r.integers(0, 26, 6))
    texts = [" ".join([*(word() for _ in range(int(r.integers(0, 9)))), *passage.split()]) for _ in range(150)]
    texts += ["the\tof and", "of the  and", "AND of\rthe", "the of and to", "to the of and in", " \x0b\x0c ", "", "a", "A ", "b"]
    rows = [(k, t + "\n" + cases.prose(50 + k % 7, 12), "en", "s", 1) for k, t in enumerate(texts)]
    want = brute_lines([(k, t) for k, t, *_ in rows])
    got = line_dedup.removed_lines(cases.frame(spark, rows, 5)).collect()
    assert all(list(x.removed) == want.get(x.doc_id, []) for x in got) and len(got) == len(rows)
    assert sum(map(len, want.values())) > 200


def test_mixing(spark):
    found = mixing.mix_sources(cases.frame(spark, DOCS)).collect()
    assert len(found) == len(DOCS)
    sizes = Counter()
    for r in DOCS:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(names, mixing.fill_targets([sizes[s] for s in names], mixing.cycle_weights(names), sum(sizes.values()), 3), strict=True))
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))
    taken = Counter()
    key = {f'["{s}"]' if s is not None else "[null]": s for s in names}
    for r in found:
        assert r.taken == r.copies * r.size <= 3 * r.size and r.target == pytest.approx(targets[key[r.pattern]]) and r.source_size == sizes[key[r.pattern]]
        taken[key[r.pattern]] += r.taken
    largest = max(r.size for r in found)
    for s in names:
        assert targets[s] <= 3 * sizes[s] + 1e-6 and abs(taken[s] - targets[s]) <= largest / 2 + 1
    again = mixing.mix_sources(cases.frame(spark, DOCS, 5)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    assert mixing.mix_sources(cases.empty(spark)).count() == 0


def test_flow_prefers_what_needs_no_repeats():
    flow = mixing.route([100, 50, 100], [[0], [0, 1], [1]], [120, 150], 3)
    to = [sum(f.get(s, 0) for f in flow) for s in (0, 1)]
    assert to == [120, 150] and all(sum(f.values()) <= 3 * c for f, c in zip(flow, [100, 50, 100], strict=True))
    # 250 words serve once; the other 20 are a second pass, whichever pattern gives it
    assert sum(max(0, sum(f.values()) - c) for f, c in zip(flow, [100, 50, 100], strict=True)) == 20
    assert sum(sum(f.values()) for f in mixing.route([10], [[0]], [100], 3)) == 30


def test_flow_of_many_sources_of_one_pattern_each():
    n = 200_000
    flow = mixing.route([10] * n + [5, 7], [[k] for k in range(n)] + [[n], [n, n + 1]], [8] * n + [6, 6], 3)
    assert all(f == {k: 8} for k, f in enumerate(flow[:n]))
    assert sum(f.get(n, 0) for f in flow[n:]) == 6 and sum(f.get(n + 1, 0) for f in flow[n:]) == 6


def test_flow_costs_no_more_than_any_other():
    from itertools import product

    r = np.random.default_rng(3)
    for _ in range(40):
        capacity, members = r.integers(0, 3, 3).tolist(), [[[0], [1], [0, 1]][k] for k in r.integers(0, 3, 3)]
        quotas, passes = r.integers(0, 7, 2).tolist(), 3
        ways = [[w for w in product(*(range(passes * c + 1) if s in m else (0,) for s in (0, 1))) if sum(w) <= passes * c] for c, m in zip(capacity, members, strict=True)]
        cost = lambda words, c: sum(2 * (k // c) + 1 for k in range(words))
        best = min((-sum(map(sum, w)), sum(cost(sum(x), c) for x, c in zip(w, capacity, strict=True))) for w in product(*ways) if all(sum(x[s] for x in w) <= quotas[s] for s in (0, 1)))
        flow = mixing.route(capacity, members, quotas, passes)
        assert all(set(f) <= set(m) for f, m in zip(flow, members, strict=True)) and all(sum(f.get(s, 0) for f in flow) <= quotas[s] for s in (0, 1))
        assert (-sum(sum(f.values()) for f in flow), sum(cost(sum(f.values()), c) for f, c in zip(flow, capacity, strict=True))) == best


def test_flow_of_many_overlapping_patterns():
    n, m = 200_000, 40
    r = np.random.default_rng(4)
    capacity = r.integers(1, 100, n).tolist()
    members = [sorted({int(a), int(b), int(c)}) for a, b, c in r.integers(0, m, (n, 3))]
    quotas = [sum(capacity) * (1 + k % 3) // 79 for k in range(m)]
    flow = mixing.route(capacity, members, quotas, 3)
    assert [sum(f.get(k, 0) for f in flow) for k in range(m)] == quotas
    assert all(sum(f.values()) <= 3 * c and set(f) <= set(mine) for f, c, mine in zip(flow, capacity, members, strict=True))
    # all quotas together are a little less than all words, but some sources want more than their patterns have
    assert sum(max(0, sum(f.values()) - c) for f, c in zip(flow, capacity, strict=True)) < sum(quotas) // 10


def test_overlapping_sources(spark):
    from pyspark.sql import functions as F

    rows = [(k, cases.prose(k, 20), None, None, 0) for k in range(60)]
    docs = cases.frame(spark, rows).withColumn("m", F.when(F.col("doc_id") < 20, F.array(F.lit("a"))).when(F.col("doc_id") < 40, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("b"))))
    got = mixing.mix_sources(docs, sources=F.col("m"), weights=lambda s: [2.0, 1.0]).toPandas()
    assert set(got.pattern) == {'["a"]', '["a","b"]', '["b"]'} and got.taken.sum() == pytest.approx(1200, abs=40)


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes(kind):
    for n, top in ((0, 1), (1, 1), (1000, 50257), (8, 2**32), (9, 1)):
        ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
        assert (token_planes.join_planes(token_planes.split_planes(ids, kind), n, kind) == ids).all()


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [r for r in DOCS if r[0] is not None]
    got = sorted(token_planes.token_files(cases.frame(spark, rows), path, block=1000, partitions=3).collect())
    start = 0
    for r, (i, t, *_) in zip(got, sorted(rows, key=lambda r: r[0]), strict=True):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        assert tuple(r) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_planes.token_files(cases.empty(spark), path).count() == 0


def test_units_give_the_tokenizers_ids():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer, units = Tokenizer.from_file(path), token_planes.UnitEncoder(path)
    r = np.random.default_rng(6)
    parts = ["a", "The", " ", "  ", "\n", "\n\n", "\t", "\r", ".", ",", "!", "'s", "'ll", "’", "é", "ß", "日本", "🙂", "\u00a0", "\u2003", "\u0085", "12", "7", "-", "_", "(", "<|endoftext|>", "x" * 40, "\u0301", "\x00"]
    texts = ["".join(parts[k] for k in r.integers(0, len(parts), int(n))) for n in r.integers(0, 30, 3000)]
    for at in range(0, len(texts), 500):
        ids, counts = units.encode(pa.array(texts[at : at + 500], pa.string()))
        ends = np.cumsum(counts)
        for t, a, b in zip(texts[at : at + 500], [0, *ends], ends, strict=False):
            assert ids[a:b].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_any_range_of_ids(tmp_path):
    out = token_planes.PlaneWriter(open(tmp_path / "x", "wb"), block=64)
    ids = np.arange(1000, dtype=np.uint32) * 7 % 511
    out.add(np.array([1, 2]), np.array([400, 600]), ids)
    out.close()
    with pa.OSFile(str(tmp_path / "x")) as f:
        reader = token_planes.PlaneReader(f)
        assert (reader.ids(130, 300) == ids[130:430]).all() and len(reader.ids(1000, 5)) == 0


def test_pieces(spark):
    model = tokenizer_path("piece_bpe_32k.model")
    docs = cases.frame(spark, DOCS)
    found = pieces.round_trip(docs, model, seed=4).collect()
    assert len(found) == len(DOCS) and all(r.lossless for r in found)
    again = pieces.encode(cases.frame(spark, DOCS, 7), model, seed=4).collect()
    key = lambda rows: sorted((r.doc_id or -1, list(r.ids)) for r in rows)
    assert key(found) == key(again)
    other = pieces.encode(docs, model, seed=5).collect()
    assert key(found) != key(other)
    text = {r.doc_id: r.decoded for r in pieces.decode(pieces.encode(docs, model), model).collect()}
    assert all(text[i] == (t or "") for i, t, *_ in DOCS)
    assert pieces.round_trip(cases.empty(spark), model).count() == 0


def test_segmentations_do_not_depend_on_what_is_kept():
    made = pieces.Pieces(tokenizer_path("piece_bpe_32k.model"))
    texts = [cases.prose(k, 200) + "x" * (300 * (k % 3)) for k in range(40)]
    row_keys = pieces.mix(np.arange(40, dtype=np.uint64))
    want = pieces.Sampler(made, 1).encode(pa.array(texts), row_keys)[0].tolist()
    small = pieces.Sampler(made, 1, max_edges=500)
    small.LEARN_BYTES = 64
    got = [small.encode(pa.array(texts[k : k + 1]), row_keys[k : k + 1])[0].tolist() for k in range(40)]
    assert sum(got, []) == want


def test_draws_follow_the_weights():
    made = pieces.Pieces(tokenizer_path("piece_bpe_32k.model"))
    n = 20_000
    ids, counts = pieces.Sampler(made).encode(pa.array(["hello"] * n), pieces.mix(np.arange(n, dtype=np.uint64)))
    ends = np.concatenate([[0], np.cumsum(counts)])
    got = Counter(tuple(ids[a:b].tolist()) for a, b in zip(ends, ends[1:], strict=False))
    number = {b: i for i, b in enumerate(made.bytes_of) if b and i >= 259}

    def paths(s):
        if not s:
            yield (), 1.0
        for k in range(1, len(s) + 1):
            if s[:k] in number:
                for rest, w in paths(s[k:]):
                    yield (number[s[:k]], *rest), w * np.exp(made.log_weight[number[s[:k]]])

    weights = dict(paths(b"hello"))
    whole = sum(weights.values())
    assert set(got) <= set(weights)
    for path, w in weights.items():
        p = w / whole
        assert abs(got[path] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-4
