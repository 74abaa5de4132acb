"""Small tables with the awkward cases: nulls, empty and very long texts, ties, repeated rows, clashing column names."""

from __future__ import annotations

import random

CLASHES = ["id", "text_", "h", "n", "component", "doc", "line", "k", "size", "band", "__id", "__text", "__gone", "__key", "score", "kept"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHES)
WORDS = "alpha beta gamma delta épsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    out = []
    for i in range(n):
        out.append(r.choice(WORDS) + str(r.randrange(vocabulary)))
        out.append("\n" if i % 12 == 11 else " ")
    return "".join(out).strip()


def changed(text: str, seed: int, share: float) -> str:
    r = random.Random(seed)
    return "\n".join(" ".join(w if r.random() > share else f"new{r.randrange(10**6)}" for w in line.split(" ")) for line in text.split("\n"))


def documents() -> list[tuple]:
    base, other = prose(1, 150), prose(2, 90)
    texts: list[str | None] = [None, "", "  \n\t ", "one", "one", "two words", "TWO words", "a b c d e", "A b  c\nd e", "?? !! 12", "日本語 の テキスト", "<|endoftext|> ▁ mark  x"]
    texts += [base, base, base.upper(), *(changed(base, k, 0.01) for k in range(12)), *(changed(other, 50 + k, 0.02) for k in range(8)), other]
    texts += [prose(3, 6000), changed(prose(3, 6000), 9, 0.002), *(prose(100 + k, 40 + 7 * k) for k in range(15))]
    rows = []
    for i, t in enumerate(texts):
        rows.append((i * 3 % 101 + 10, t, [None, "de", "en"][i % 3], [None, "s1", "s2", "s3", ""][min(i % 7, 4)], None if t is None else len(t)))
    rows.append(rows[12])  # a repeated row
    rows.append((None, base, "en", "s1", len(base)))
    return rows


def frame(spark, rows, partitions: int = 3):
    return spark.createDataFrame([(*r, *("x" for _ in CLASHES)) for r in rows], SCHEMA).repartition(partitions)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def components(ids: list, links: list[tuple]) -> dict:
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
