"""Languages of words in code-switched text by a linear-chain conditional random field.

A line is a chain of words. A word's features are itself, its affixes of 1 to 3 bytes, its byte pairs and triples (all hashed into one
table of weights for each language), and whether it is in the lexicon of frequent words of a language. Weights and transitions are learned
by the gradient of the chains' log-likelihood; training lines are spliced from several languages, so that switches are seen. Forward-backward
gives each word's posterior, and a text's language is that with the greatest sum.

Scale: fitting takes a bounded sample of each language (``max_rows`` texts, chosen by a hash of the id; the only rows that reach the
driver). Labelling is one pass over whole texts without a shuffle. Features are computed once for the distinct words of some
megabytes of text, and chains of all lengths advance together, one word a step.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecrest.llm.toxicity import IN_WORD, fold
from wavecrest.llm.words import Texts, chunks, keys

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
CHUNK = 4 << 20


class Chains:
    """Words of texts and the lines that they form: line i has words first[i] to first[i + 1]; all in order of place."""

    def __init__(self, column: pa.Array | list):
        self.texts = texts = Texts(column, lower=True)
        starts, ends = texts.segments(texts.offsets, IN_WORD[texts.data])
        letters = np.concatenate([[0], np.cumsum(LETTER[texts.data])])
        some = letters[ends] > letters[starts]
        self.starts, self.ends = starts[some], ends[some]
        breaks = np.union1d(np.flatnonzero(texts.data == 10), texts.offsets)
        self.first = np.unique(np.append(np.searchsorted(self.starts, breaks), [0, len(self.starts)]))
        self.first_of_text = np.searchsorted(self.starts, texts.offsets)
        hashes = texts.hash_spans(self.starts, self.ends)
        self.words, where, self.which = np.unique(hashes, return_index=True, return_inverse=True)
        self.sample = np.sort(where)  # a place of each distinct word, ascending, as hash_spans wants it
        self.order = np.argsort(where)  # distinct word of each such place


def word_features(chains: Chains, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the table of weights for each distinct word, in order of ``sample``: (words, 7) of the word and its affixes; and
    those of its byte pairs and triples end to end, with the word of each."""
    t, starts, ends = chains.texts, chains.starts[chains.sample], chains.ends[chains.sample]
    spans = [(starts, ends)]
    for k in (1, 2, 3):
        spans += [(starts, np.minimum(starts + k, ends)), (np.maximum(ends - k, starts), ends)]
    salts = keys(9, 23)
    whole = np.stack([((t.hash_spans(a, b) ^ s) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(buckets) for (a, b), s in zip(spans, salts, strict=False)], axis=1) if len(starts) else np.zeros((0, 7))
    lengths = ends - starts
    place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at, word = place + np.repeat(starts, lengths), np.repeat(np.arange(len(starts)), lengths)
    data = np.concatenate([t.data, np.zeros(2, np.uint8)]).astype(np.uint64)
    two, three = place < np.repeat(lengths - 1, lengths), place < np.repeat(lengths - 2, lengths)
    pair = data[at[two]] * np.uint64(256) + data[at[two] + 1]
    triple = (data[at[three]] * np.uint64(256) + data[at[three] + 1]) * np.uint64(256) + data[at[three] + 2]
    grams = np.concatenate([(pair + np.uint64(1)) * salts[7], (triple + np.uint64(1)) * salts[8]])
    grams = ((grams * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    return whole.astype(np.int64), grams, np.concatenate([word[two], word[three]])


def forward_backward(emission: np.ndarray, transition: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (words, labels), and expected transitions (labels, labels), of all chains; emission is (words, labels)."""
    n, k = emission.shape
    e = np.exp(emission - emission.max(axis=1, keepdims=True)) if n else emission
    a = np.exp(transition)
    order = np.argsort(-np.diff(first), kind="stable")
    starts, lengths = first[:-1][order], np.diff(first)[order]
    starts, lengths = starts[lengths > 0], lengths[lengths > 0]
    alpha, beta = np.empty((n, k), e.dtype), np.ones((n, k), e.dtype)
    expected = np.zeros((k, k))
    if not len(starts):
        return alpha, expected
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # chains longer than t
    x = e[starts] / e[starts].sum(axis=1, keepdims=True)
    alpha[starts] = x
    for t in range(1, lengths[0]):
        at = starts[: active[t]] + t
        x = (x[: active[t]] @ a) * e[at]
        x /= x.sum(axis=1, keepdims=True)
        alpha[at] = x
    for t in range(lengths[0] - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        nxt = e[at + 1] * beta[at + 1]
        both = alpha[at].T @ (nxt / np.maximum((alpha[at] * (nxt @ a.T)).sum(axis=1, keepdims=True), 1e-30))
        expected += a * both
        y = nxt @ a.T
        beta[at] = y / y.sum(axis=1, keepdims=True)
    gamma = alpha * beta
    return gamma / gamma.sum(axis=1, keepdims=True), expected


@dataclass
class Field:
    languages: list[str]
    buckets: int = 1 << 15
    lexicons: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        k = len(self.languages)
        self.weights = np.zeros((self.buckets, k), np.float32)
        self.of_lexicon = np.zeros((k, k), np.float32)
        self.transition = np.zeros((k, k), np.float64)

    def in_lexicon(self, chains: Chains) -> np.ndarray:
        words = chains.words[chains.order]
        return np.stack([np.isin(words, x) for x in self.lexicons], axis=1).astype(np.float32)

    def emissions(self, chains: Chains) -> np.ndarray:
        """(distinct words, labels), in the order of ``words``."""
        whole, grams, word = word_features(chains, self.buckets)
        out = self.weights[whole].sum(axis=1)
        k = len(self.languages)
        for y in range(k):
            out[:, y] += np.bincount(word, weights=self.weights[grams, y], minlength=len(out))
        out += self.in_lexicon(chains) @ self.of_lexicon
        back = np.empty_like(out)
        back[chains.order] = out
        return back

    def posteriors(self, chains: Chains) -> np.ndarray:
        """(words, labels)"""
        return forward_backward(self.emissions(chains)[chains.which].astype(np.float64), self.transition, chains.first)[0]

    def gradients(self, chains: Chains, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the log likelihood of labels y: by weights, by lexicon weights and by transitions."""
        k = len(self.languages)
        emission = self.emissions(chains)[chains.which].astype(np.float64)
        gamma, expected = forward_backward(emission, self.transition, chains.first)
        error = -gamma
        error[np.arange(len(y)), y] += 1
        inner = np.ones(len(y), bool)
        inner[chains.first[:-1]] = False
        to = np.flatnonzero(inner)
        counted = np.zeros((k, k))
        np.add.at(counted, (y[to - 1], y[to]), 1)
        by_word = np.stack([np.bincount(chains.which, weights=error[:, j], minlength=len(chains.words)) for j in range(k)], axis=1)[chains.order]
        whole, grams, word = word_features(chains, self.buckets)
        rows = np.concatenate([whole.reshape(-1), grams])
        source = np.concatenate([np.repeat(np.arange(len(whole)), whole.shape[1]), word])
        of_weights = np.stack([np.bincount(rows, weights=by_word[source, j], minlength=self.buckets) for j in range(k)], axis=1)
        return of_weights, self.in_lexicon(chains).T @ by_word, counted - expected

    def fit(self, lines: list[tuple[str, np.ndarray]], epochs: int = 4, batch: int = 400, rate: float = 0.3, decay: float = 1e-6) -> None:
        """lines: text without line feeds, and the label of each of its words."""
        held = [self.weights, self.of_lexicon, self.transition]
        seen = [np.full_like(p, 1e-2) for p in held]
        r = np.random.default_rng(1)
        for _ in range(epochs):
            order = r.permutation(len(lines))
            for at in range(0, len(order), batch):
                chosen = [lines[i] for i in order[at : at + batch]]
                grads = self.gradients(Chains([text for text, _ in chosen]), np.concatenate([labels for _, labels in chosen]))
                for p, g, s in zip(held, grads, seen, strict=True):
                    g = g / len(chosen)
                    s += g * g
                    p += (rate * g / np.sqrt(s)).astype(p.dtype)
                self.weights *= 1 - decay


def train(texts: list[str], labels: list[str], lexicon_size: int = 2000, seed: int = 2, **options) -> Field:
    """A field fitted to texts of one language each. Half of the training lines are spliced from runs of several."""
    names = sorted(set(labels))
    model = Field(names, **options)
    r = np.random.default_rng(seed)
    lines: list[tuple[list[str], int]] = []
    for text, label in zip(texts, labels, strict=True):
        chains = Chains([text])
        data = chains.texts.data
        words = [data[a:b].tobytes().decode(errors="replace") for a, b in zip(chains.starts.tolist(), chains.ends.tolist(), strict=True)]
        for a, b in zip(chains.first.tolist(), chains.first[1:].tolist(), strict=False):
            for at in range(a, b, 60):  # long lines are learned from in parts
                if b > at:
                    lines.append((words[at : min(at + 60, b)], names.index(label)))
    for k in range(len(names)):
        all_words = [w for words, y in lines if y == k for w in words]
        if all_words:
            found = Chains([" ".join(all_words)])
            counts = np.bincount(found.which, minlength=len(found.words))
            model.lexicons.append(np.sort(found.words[np.argsort(-counts, kind="stable")[:lexicon_size]]))
        else:
            model.lexicons.append(np.zeros(0, np.uint64))
    made = []
    for words, y in lines:
        tags = [y] * len(words)
        if len(lines) > 1 and r.random() < 0.5:
            other, z = lines[int(r.integers(len(lines)))]
            a = int(r.integers(len(words) + 1))
            b = int(r.integers(1, min(len(other), 20) + 1))
            words, tags = words[:a] + other[:b] + words[a:], tags[:a] + [z] * b + tags[a:]
        made.append((" ".join(words), np.array(tags)))
    made = [(text, tags) for text, tags in made if len(Chains([text]).starts) == len(tags)]
    if made and len(names) > 1:
        model.fit(made)
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, out_fold: int = 2, max_rows: int = 300, max_languages: int = 500, **options) -> Field | None:
    """A field learned from texts and non-null languages of docs outside fold ``out_fold`` (crc32 of the id as text, modulo
    ``folds``): of each language about ``max_rows`` different texts, the bound of the sample; rows that repeat an id and text count once. None if there are none. The ``max_languages`` languages of
    the most texts are learned, the bound of the model's size; others are never predicted."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("__id"), F.col(text_col).alias("__text"), F.col(lang_col).cast("string").alias("__lang"))
    rows = rows.where(F.col("__lang").isNotNull() & F.col("__id").isNotNull() & F.col("__text").isNotNull() & (fold(F.col("__id"), folds) != out_fold))
    rows = rows.withColumn("__k", F.xxhash64("__id", "__text"))
    counts = {r[0]: r[1] for r in rows.select("__lang", "__id", "__k").distinct().groupBy("__lang").count().orderBy(F.desc("count"), "__lang").limit(max_languages).collect()}
    if not counts:
        return None
    whole = 1 << 40
    share = F.lit(0).cast("bigint")
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("__lang") == lang, F.lit(min(whole, whole * 2 * max_rows // n))).otherwise(share)
    drawn = rows.withColumn("__h", F.pmod("__k", F.lit(whole))).where(F.col("__h") < share)
    drawn = drawn.groupBy("__lang", "__id", "__k").agg(F.min("__h").alias("__h"), F.first("__text").alias("__text"))
    # about twice as many are drawn as are taken; the limit holds whatever the hash does
    table = drawn.orderBy("__h", "__id").limit(4 * max_rows * len(counts)).toArrow().sort_by([("__h", "ascending"), ("__id", "ascending"), ("__text", "ascending")])
    texts, labels, taken = [], [], dict.fromkeys(counts, 0)
    for text, lang in zip(table.column("__text").to_pylist(), table.column("__lang").to_pylist(), strict=True):
        if taken[lang] < max_rows:
            taken[lang] += 1
            texts.append(text)
            labels.append(lang)
    return train(texts, labels, **options)


SPANS = "array<struct<start: bigint, end: bigint, lang: string>>"


def label(docs: DataFrame, model: Field | None, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, out_fold: int = 2, spans: bool = False) -> DataFrame:
    """Returns a row per row of docs: id_col, held_out (in fold ``out_fold``), lang_pred and score (the mean posterior of that language
    over the text's words); with ``spans`` also the runs of words of one language, as places in the text's UTF-8 bytes.

    Null texts and texts without a letter are ``und`` with score 0, and so is every text without a model. Of equal sums the first
    language by code point wins. Rows that repeat an id are labelled one by one; a null id is in no fold. Other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "__text", CHUNK):
                column = part.column("__text")
                model = shared.value
                n = part.num_rows
                pred, score = np.full(n, -1), np.zeros(n)
                names = np.array([*(model.languages if model else []), "und"], object)
                runs_of: list = [[] for _ in range(n)]
                chains = Chains(column)
                if model and len(chains.starts):
                    p = model.posteriors(chains)
                    cum = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, axis=0)])
                    sums = cum[chains.first_of_text[1:]] - cum[chains.first_of_text[:-1]]
                    words = np.diff(chains.first_of_text)
                    some = words > 0
                    pred[some] = sums[some].argmax(axis=1)
                    score[some] = np.clip(sums[some].max(axis=1) / words[some], 0, 1)
                    # bytes of 128 and more needn't be letters
                    ascii_letters = np.concatenate([[0], np.cumsum(LETTER[chains.texts.data] & (chains.texts.data < 128))])
                    o = chains.texts.offsets
                    for i in np.flatnonzero(some & (ascii_letters[o[1:]] == ascii_letters[o[:-1]])).tolist():
                        if not any(c.isalpha() for c in column[i].as_py() or ""):
                            pred[i], score[i] = -1, 0
                    if spans:
                        best = p.argmax(axis=1)
                        for i in np.flatnonzero(pred >= 0).tolist():
                            a, b = chains.first_of_text[i], chains.first_of_text[i + 1]
                            edge = np.concatenate([[a], a + 1 + np.flatnonzero(best[a + 1 : b] != best[a : b - 1]), [b]])
                            runs_of[i] = [{"start": int(chains.starts[x] - o[i]), "end": int(chains.ends[y - 1] - o[i]), "lang": names[best[x]]} for x, y in zip(edge, edge[1:], strict=False)]
                out = [part.column("__id"), pa.array(names[pred], pa.string()), pa.array(score)]
                if spans:
                    out.append(pa.array(runs_of, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays(out, ["__id", "lang_pred", "score", *(["spans"] if spans else [])])

    rows = docs.select(F.col(id_col).cast("bigint").alias("__id"), F.col(text_col).alias("__text"))
    found = rows.mapInArrow(run, "__id bigint, lang_pred string, score double" + (f", spans {SPANS}" if spans else ""))
    held = F.coalesce(fold(F.col("__id"), folds) == out_fold, F.lit(False))
    return found.select(F.col("__id").alias(id_col), held.alias("held_out"), "lang_pred", "score", *(["spans"] if spans else []))
