"""Toxicity by a convolutional text classifier, trained in numpy.

Words are looked up in a table of hashed embeddings (a word's vector is the sum of the rows of the word and of its first 4, 5
and 6 bytes, so inflected forms share rows), filters of several widths run over them, and each filter's greatest value
over the text goes into a logistic layer. Thresholds are calibrated by language; the language is itself guessed from the text, by
letter pairs, so that nothing but the text enters a score.

Scale: fitting takes a bounded sample of labelled rows (``max_rows`` of each class, chosen by a hash of the id; the only rows that
reach the driver). Scoring is one pass over whole texts, without a shuffle; the model is a few megabytes, whatever the input.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecrest.llm.shared import give_back
from wavecrest.llm.words import Texts, chunks

IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[65:91] = IN_WORD[97:123] = IN_WORD[128:] = True
PREFIXES = (4, 5, 6)
PAD = 0
#: Share of a word's rows that a training step leaves out, so that none of them is relied on alone.
DROP = 0.5


def word_rows(texts: Texts, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, 4) rows of the embedding table, and where each text's words begin. Row 0 is kept for padding."""
    starts, ends = texts.segments(texts.offsets, IN_WORD[texts.data])
    spans = [ends, *(np.minimum(starts + k, ends) for k in PREFIXES)]
    salt = np.arange(4, dtype=np.uint64)
    rows = [((texts.hash_spans(starts, e) + s) % np.uint64(buckets - 1)).astype(np.int32) + 1 for s, e in zip(salt, spans, strict=True)]
    return np.stack(rows, axis=1) if len(starts) else np.zeros((0, 4), np.int32), np.searchsorted(starts, texts.offsets)


def letter_pairs(texts: Texts, buckets: int = 1024) -> np.ndarray:
    """(texts, buckets): how often each hashed pair of adjacent bytes of words occurs."""
    d = texts.data.astype(np.int64)
    out = np.zeros((texts.n, buckets), np.float32)
    if len(d) > 1:
        good = IN_WORD[texts.data[:-1]] & IN_WORD[texts.data[1:]]
        good[texts.offsets[(texts.offsets > 0) & (texts.offsets < len(d))] - 1] = False
        at = np.flatnonzero(good)
        key = (d[at] * 31 + d[at + 1] * 1009) % buckets
        np.add(out.reshape(-1), np.bincount(texts.text_of(at) * buckets + key, minlength=texts.n * buckets).astype(np.float32), out=out.reshape(-1))
    return out


@dataclass
class Model:
    buckets: int = 1 << 15
    size: int = 16
    filters: int = 12
    widths: tuple[int, ...] = (1, 2, 3)
    seed: int = 5
    languages: list[str] = field(default_factory=list)

    def __post_init__(self):
        r = np.random.default_rng(self.seed)
        self.table = r.normal(0, 0.1, (self.buckets, self.size)).astype(np.float32)
        self.table[PAD] = 0
        self.kernels = [r.normal(0, (1 / (w * self.size)) ** 0.5, (w, self.size, self.filters)).astype(np.float32) for w in self.widths]
        self.bias = np.zeros(self.filters * len(self.widths), np.float32)
        self.weight = np.full(self.filters * len(self.widths), 0.3, np.float32) * np.tile(np.array([1, 1, 1, -1], np.float32), self.filters * len(self.widths) // 4)
        self.offset = np.float32(0)
        self.shift = 0.0  # of the logit, by what share of each class the sample took
        self.pairs = np.zeros((0, 1024), np.float32)
        self.thresholds = np.zeros(1, np.float32)

    def padded(self, rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts' rows end to end, with padding behind each, and where each begins."""
        gap = max(self.widths)
        counts = np.diff(first)
        out = np.zeros((len(rows) + gap * len(counts), rows.shape[1]), np.int32)
        out[np.arange(len(rows)) + np.repeat(np.arange(len(counts)) * gap, counts)] = rows
        return out, first[:-1] + np.arange(len(counts)) * gap

    def maps(self, rows: np.ndarray) -> np.ndarray:
        x = self.table[rows[:, 0]]
        for k in range(1, rows.shape[1]):
            x += self.table[rows[:, k]]
        n = len(x)
        x = np.concatenate([x, np.zeros((max(self.widths), self.size), np.float32)])
        # one product for all places of all filters, then each filter's places are added
        y = x @ np.concatenate([kernel[j] for kernel in self.kernels for j in range(len(kernel))], axis=1)
        out, at = np.empty((n, len(self.bias)), np.float32), 0
        for k, kernel in enumerate(self.kernels):
            part = out[:, k * self.filters : (k + 1) * self.filters]
            part[:] = y[:n, at : at + self.filters]
            for j in range(1, len(kernel)):
                part += y[j : j + n, at + j * self.filters : at + (j + 1) * self.filters]
            at += len(kernel) * self.filters
        return out

    def logits(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        rows, starts = self.padded(rows, first)
        if not len(starts):
            return np.zeros(0, np.float32)
        top = np.maximum.reduceat(self.maps(rows), starts, axis=0)
        return np.maximum(top + self.bias, 0) @ self.weight + self.offset + self.shift

    def gradients(self, padded: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, float]:
        """Of the mean log loss (and 5e-5 of the squared last weights): gradients of kernels, bias and weight; rows of the table, with
        the gradient of each; and the gradient of the offset."""
        maps = self.maps(padded)
        ends = np.append(starts[1:], len(maps))
        best = np.array([maps[a:b].argmax(axis=0) + a for a, b in zip(starts, ends, strict=True)])
        raw = maps[best, np.arange(maps.shape[1])] + self.bias
        top = np.maximum(raw, 0)
        z = top @ self.weight + self.offset
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels).astype(np.float32) / len(labels)
        d_top = g[:, None] * self.weight * (raw > 0)
        dense, touched, into = [], [], []
        for k, kernel in enumerate(self.kernels):
            part = slice(k * self.filters, (k + 1) * self.filters)
            d, at_best = d_top[:, part], best[:, part]
            dk = np.zeros_like(kernel)
            for j in range(len(kernel)):
                ids = padded[np.minimum(at_best + j, len(padded) - 1)]  # texts, filters, 4
                x = self.table[ids].sum(axis=2)
                dk[j] = np.einsum("tf,tfe->ef", d, x)
                dx = d[:, :, None] * kernel[j].T[None]
                touched.append(ids.reshape(-1, 4))
                into.append(dx.reshape(-1, self.size))
            dense.append(dk)
        dense += [d_top.sum(axis=0), top.T @ g + 1e-4 * self.weight]
        ids = np.concatenate(touched).reshape(-1)
        dx = np.repeat(np.concatenate(into), 4, axis=0)
        used = np.abs(dx).sum(axis=1) > 0
        unique, inverse = np.unique(ids[used], return_inverse=True)
        total = np.zeros((len(unique), self.size), np.float32)
        np.add.at(total, inverse, dx[used])
        return dense, unique, total, float(g.sum())

    def fit(self, rows: np.ndarray, first: np.ndarray, labels: np.ndarray, keep: np.ndarray, batch: int = 32, rate: float = 0.01, least_steps: int = 480) -> None:
        """At least four passes over the texts ``keep``, and more over few, up to least_steps batches."""
        epochs = max(4, -(-least_steps * batch // len(keep)))
        r = np.random.default_rng(self.seed + 1)
        dense = [*self.kernels, self.bias, self.weight]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in dense]
        seen = np.full(len(self.table), 1e-6, np.float32)
        step = 0
        for _ in range(epochs):
            order = keep[r.permutation(len(keep))]
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                counts = first[chosen + 1] - first[chosen]
                words = np.concatenate([rows[first[k] : first[k + 1]] for k in chosen])
                words = np.where(r.random(words.shape) < DROP, PAD, words)
                padded, starts = self.padded(words, np.concatenate([[0], np.cumsum(counts)]))
                grads, unique, total, g = self.gradients(padded, starts, labels[chosen])
                self.offset -= np.float32(rate * g * 5)
                step += 1
                for p, d, (m, v) in zip(dense, grads, moments, strict=True):
                    m *= 0.9
                    m += 0.1 * d
                    v *= 0.999
                    v += 0.001 * d * d
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
                seen[unique] += (total * total).mean(axis=1)
                self.table[unique] -= 10 * rate * total / np.sqrt(seen[unique])[:, None]
                self.table[PAD] = 0

    def guess(self, pairs: np.ndarray) -> np.ndarray:
        """The place in ``languages`` of each text's likeliest language; -1 without any letter pair."""
        if not len(self.pairs):
            return np.full(len(pairs), -1)
        return np.where(pairs.sum(axis=1) > 0, (pairs @ self.pairs.T).argmax(axis=1), -1)

    def score(self, column: pa.Array) -> np.ndarray:
        """Scores between 0 and 1; 0.5 is the threshold of the text's guessed language."""
        texts = Texts(column, lower=True)
        z = self.logits(*word_rows(texts, self.buckets))
        z = z - self.thresholds[self.guess(letter_pairs(texts))]  # the last is for all languages
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def best_threshold(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Halfway between the two logits between which the weighted errors are fewest (the middle of the widest such gap)."""
    order = np.argsort(z)
    z, y, w = z[order], y[order], w[order]
    errors = np.concatenate([[0.0], np.cumsum(np.where(y == 1, w, -w))]) + w[y == 0].sum()
    edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    gaps = np.concatenate([[0], np.diff(z), [0]])
    least = np.flatnonzero(errors <= errors.min() + 1e-9)
    return float(edges[least[gaps[least].argmax()]])


def train(texts: list[str | None], labels: list[int], languages: list[str | None], counts: tuple[int, int], **options) -> Model:
    """A model fitted to the sample. counts: how many rows of label 0 and of 1 there are in all, of which the sample has some.

    Every fourth text is held back to calibrate thresholds. Without rows of both labels the model gives the more common one."""
    y = np.array(labels, np.float32)
    names = sorted({x for x in languages if x is not None})
    model = Model(languages=names, **options)
    both = y.sum() >= 4 and (1 - y).sum() >= 4
    if not both:
        model.weight[:] = 0
        model.shift = 1.0 if counts[1] > counts[0] else -1.0
        return model
    parts = [word_rows(Texts(texts[k : k + 128], lower=True), model.buckets) for k in range(0, len(texts), 128)]
    rows = np.concatenate([r for r, _ in parts])
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f) for _, f in parts]))])
    del parts
    held = np.arange(len(y)) % 4 == 3
    if len(y) < 200:
        held[:] = False
    keep = np.flatnonzero(~held)
    model.fit(rows, first, y, keep)
    # the sample's classes count as often as in all rows
    share = [(y == k).sum() / max(1, counts[k]) for k in (0, 1)]
    model.shift = float(np.log(share[0] / share[1]))
    weight = np.where(y == 1, 1 / share[1], 1 / share[0])
    z = np.concatenate([model.logits(rows[first[k] : first[min(k + 64, len(y))]], first[k : min(k + 64, len(y)) + 1] - first[k]) for k in range(0, len(y), 64)])
    pairs = np.concatenate([letter_pairs(Texts(texts[k : k + 128], lower=True)) for k in range(0, len(texts), 128)])
    if names:
        spoken = np.array([names.index(x) if x is not None else -1 for x in languages])
        sums = np.stack([pairs[spoken == k].sum(axis=0) for k in range(len(names))]) + 0.1
        model.pairs = np.log(sums / sums.sum(axis=1, keepdims=True)).astype(np.float32)
    fit_on = held if held.any() else np.ones(len(y), bool)
    def calibrated(mine: np.ndarray, prior: float) -> float:
        """The best threshold of these texts, drawn towards ``prior`` as if 20 more marked texts spoke for that."""
        n = int((y[mine] == 1).sum())
        if not n or not (y[mine] == 0).any():
            return prior
        return (n * best_threshold(z[mine], y[mine], weight[mine]) + 20 * prior) / (n + 20)

    overall = calibrated(fit_on, 0.0)
    guessed = model.guess(pairs)
    thresholds = [calibrated(fit_on & (guessed == k), overall) for k in range(len(names))]
    model.thresholds = np.array([*thresholds, overall], np.float32)
    return model


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, label_col: str, max_rows: int, trainable):
    """At most max_rows rows of each label, by a hash of their id, and how many rows each label has in all."""
    marked = labels.select(F.col(id_col).cast("bigint").alias("__id"), F.col(label_col).cast("int").alias("__y"))
    marked = marked.where(F.col("__y").isin(0, 1) & F.col("__id").isNotNull()).where(trainable(F.col("__id"))).groupBy("__id").agg(F.max("__y").alias("__y"))
    totals = {r[0]: r[1] for r in marked.groupBy("__y").count().collect()}
    chosen = [marked.where(F.col("__y") == k).orderBy(F.xxhash64("__id"), "__id").limit(max_rows) for k in (0, 1)]
    texts = docs.select(F.col(id_col).cast("bigint").alias("__id"), F.col(text_col).alias("__text"), F.col(lang_col).cast("string").alias("__lang"))
    one = texts.join(chosen[0].unionAll(chosen[1]), "__id").groupBy("__id", "__y").agg(F.min(F.struct("__text", "__lang")).alias("r"))
    table = one.select("__id", "__y", "r.*").toArrow()
    order = sorted(range(table.num_rows), key=lambda i, ids=table.column("__id").to_pylist(): (ids[i] * 0x9E3779B97F4A7C15 & (1 << 64) - 1, ids[i]))
    table = table.take(pa.array(order, pa.int64()))
    return table.column("__text").to_pylist(), table.column("__y").to_pylist(), table.column("__lang").to_pylist(), (totals.get(0, 0), totals.get(1, 0))


def fold(key, folds: int):
    """crc32 of an id as text, modulo folds."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", max_rows: int = 2000, folds: int = 5, **options) -> Model:
    """A model from labelled rows of docs outside fold 0 (crc32 of the id as text, modulo ``folds``): of each label at most
    ``max_rows``, the bound of the sample. The driver keeps the model only."""
    model = train(*sample(docs, labels, id_col, text_col, lang_col, label_col, max_rows, lambda key: fold(key, folds) != 0), **options)
    give_back()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, keep: list[str] | None = None) -> DataFrame:
    """Returns a row per row of docs: id_col, held_out (fold 0), score (0 to 1) and predicted (1 if score >= 0.5, else 0).

    Null, empty and wordless texts get the score that the filters give to nothing. Rows that repeat an id are scored one by
    one; a null id is in no fold. Other columns are ignored; or ``keep`` names columns to be returned too, in place of id_col."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passed = keep if keep is not None else [id_col]
    text = f"__c{passed.index(text_col)}" if text_col in passed else "__text"  # a kept text isn't sent twice
    rows = docs.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(passed)], *([F.col(text_col).alias("__text")] if text == "__text" else []))
    names = [c for c in rows.columns if c != "__text"]
    schema = rows.select(*names).schema.add("__score", "double")

    def run(batches):
        for batch in batches:
            for part in chunks(batch, text, 1 << 18):
                scores = shared.value.score(part.column(text))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(scores)], [*names, "__score"])

    found = rows.mapInArrow(run, schema)
    out = [F.col(f"__c{i}").alias(c) for i, c in enumerate(passed)]
    if keep is not None:
        return found.select(*out, F.col("__score"))
    key = F.col("__c0").cast("bigint")
    return found.select(*out, F.coalesce(fold(key, folds) == 0, F.lit(False)).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))
