"""Quality rules with cross-document line frequency.

Normalised lines are hashed, the distinct documents of each host (source) that hold a line are counted, lines above the
host's limit are taken out of the texts, and documents that are depleted by this are rejected.

Scale: one row per distinct line of a document is shuffled, as (host, hash, document); counts are partially aggregated, and
so a line that a third of all documents share is summed before the shuffle. Frequent lines, of which there are
less than a tenth of the lines of all documents, are joined back with a plain equi-join, which adaptive execution may split or broadcast by size.
Each document's frequent hashes are then joined to its text, which is rebuilt without these lines; only texts that may hold such a line, as a
table of bits of fixed size tells, are shuffled for it, the others are read where they lie.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecrest.llm.shared import cut, drop, maybe_in
from wavecrest.llm.words import SPACE, Texts, Words, chunks, mix

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

#: Normalising a line, byte by byte: A-Z to lower case, digits to 0; ASCII punctuation and white space are left out.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[48:58] = 48
KEPT = np.ones(256, bool)
KEPT[:48] = KEPT[58:65] = KEPT[91:97] = KEPT[123:128] = False

LINES = "__row bigint, __host string, __tie bigint, h bigint"
FEATURES = (
    "__row bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "lost_lines bigint, lost_words bigint, removed array<int>, __clean string"
)


def lines_of(texts: Texts, words: Words) -> tuple[np.ndarray, ...]:
    """Starts, ends, texts and numbers of words of all lines that hold a word."""
    breaks = np.flatnonzero(texts.data == 10)
    starts = np.union1d(texts.offsets[:-1][texts.offsets[:-1] < texts.offsets[1:]], breaks + 1)
    starts = starts[starts < len(texts.data)]
    bounds = np.append(starts, len(texts.data))
    ends = bounds[1:].copy()
    closed = texts.data[np.maximum(ends - 1, 0)] == 10
    ends -= closed
    n = np.diff(np.searchsorted(words.starts, bounds))
    full = n > 0
    starts, ends = starts[full], ends[full]
    return starts, ends, texts.text_of(starts), n[full]


def repeat_words(words: Words, hashes: np.ndarray, size: int) -> np.ndarray:
    """For each text the words within windows of ``size`` words that the text holds twice or more."""
    windows, first = words.windows(hashes, size)
    out = np.zeros(words.texts.n, np.int64)
    if not len(windows):
        return out
    text = np.repeat(np.arange(words.texts.n), np.diff(first))
    tagged = mix(windows + text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(tagged, kind="stable")
    s = tagged[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = order[twice]
    word = hit - first[text[hit]] + words.first[text[hit]]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, word, 1)
    np.add.at(cover, np.minimum(word + size, len(hashes)), -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover)[:-1] > 0)])
    return covered[words.first[1:]] - covered[words.first[:-1]]


def folded_lines(texts: Texts, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the lines have a normalised form (a line of punctuation alone has none), and the hashes of these forms."""
    folded = Texts.__new__(Texts)
    keep = KEPT[texts.data]
    place = np.concatenate([[0], np.cumsum(keep)])
    folded.data, folded.offsets, folded.n = FOLD[texts.data[keep]], place[texts.offsets], texts.n
    a, b = place[starts], place[ends]
    some = b > a
    return some, folded.hash_spans(a[some], b[some])


def tagged(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes that tell apart the lines of different texts."""
    return mix(hashes + text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def line_hashes(batches):
    """A row per distinct normalised line of each text."""
    for batch in batches:
        for part in chunks(batch, "__text"):
            texts = Texts(part.column("__text"))
            starts, ends, text, _ = lines_of(texts, texts.words())
            some, h = folded_lines(texts, starts, ends)
            t = text[some]
            at = np.sort(np.unique(tagged(h, t), return_index=True)[1])
            of = pa.array(t[at])
            cols = [part.column(c).take(of) for c in ("__row", "__host", "__tie")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(h[at].view(np.int64))], ["__row", "__host", "__tie", "h"])


def features(batches, size: int):
    """Figures of each text, and the text without its lines whose hashes are in __frequent."""
    for batch in batches:
        for part in chunks(batch, "__text"):
            texts = Texts(part.column("__text"))
            words = texts.words()
            head = texts.data & 0xC0 != 0x80
            points = np.concatenate([[0], np.cumsum(head & ~SPACE[texts.data])])
            symbols = np.concatenate([[0], np.cumsum(SYMBOLS[texts.data])])
            span = lambda c: c[texts.offsets[1:]] - c[texts.offsets[:-1]]  # noqa: E731, B023
            starts, ends, text, n = lines_of(texts, words)
            distinct = np.unique(tagged(texts.hash_spans(starts, ends), text), return_index=True)[1]
            dup = np.bincount(text, minlength=texts.n) - np.bincount(text[distinct], minlength=texts.n)
            lists = part.column("__frequent")
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            gone = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            some, h = folded_lines(texts, starts, ends)
            t, w = text[some], n[some]
            marks = tagged(h, t)
            lost = np.isin(marks, tagged(gone, np.repeat(np.arange(texts.n), sizes)))
            t, w, marks, first = t[lost], w[lost], marks[lost], starts[some][lost]
            lost_lines = np.bincount(t[np.unique(marks, return_index=True)[1]], minlength=texts.n)
            lost_words = np.bincount(t, weights=w, minlength=texts.n)
            # numbers of the removed lines, counted from 0 at the text's start, and the rest of each text
            breaks = np.flatnonzero(texts.data == 10)
            number = np.searchsorted(breaks, first) - np.searchsorted(breaks, texts.offsets[t])
            bounds = np.searchsorted(t, np.arange(texts.n + 1)).astype(np.int32)
            clean = part.column("__text").to_pylist()
            for i in np.flatnonzero(np.diff(bounds)).tolist():
                out = set(number[bounds[i] : bounds[i + 1]].tolist())
                clean[i] = "\n".join([x for k, x in enumerate(clean[i].split("\n")) if k not in out])
            removed = pa.ListArray.from_arrays(bounds, pa.array(number.astype(np.int32)))
            cols = [words.counts, span(points), span(symbols), dup, repeat_words(words, words.hashes(), size), lost_lines, lost_words]
            yield pa.RecordBatch.from_arrays(
                [part.column("__row"), *(pa.array(c.astype(np.int64)) for c in cols), removed, pa.array(clean, pa.string())],
                ["__row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_lines", "lost_words", "removed", "__clean"],
            )


def clean_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_docs: int = 10,
    max_lost: float = 0.5,
    min_words: int = 20,
    window: int = 8,
    max_repeat_percent: int = 30,
) -> DataFrame:
    """Returns a row per document: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    lost_lines and lost_words (distinct frequent lines of the document, and the words of all that are removed), removed (numbers of the
    removed lines, from 0, ascending), then text_col without these lines.

    A line is what lies between line feeds. It is frequent if more than ``max_docs`` distinct documents of its host hold it, however many
    documents the host has. Lines are compared after A-Z are lower-cased, digits made 0, and ASCII punctuation and white
    space left out; lines without words, and lines of punctuation alone, are never frequent. Every occurrence of a frequent line is
    removed, from rejected documents too. A document is rejected if it fails the base rules (n_words < min_words or n_repeat_words above
    max_repeat_percent of n_words, before lines are removed), or if frequent lines take more than ``max_lost`` of its words or leave fewer
    than ``min_words``.

    Null texts count as empty and so fail, and stay null; a null host is a host of its own. Rows that repeat an id are counted as one
    document of their host, and each loses its own frequent lines; so do rows with a null id, which are all counted as one document.
    Other columns are ignored.
    """
    row, text = F.col(id_col).cast("bigint"), F.col(text_col)
    # rows with a null id are told apart by their text
    tie = F.when(row.isNull(), F.xxhash64(text)).otherwise(F.lit(0).cast("bigint"))
    rows = docs.select(row.alias("__row"), text.alias("__text"), F.col(host_col).cast("string").alias("__host"), tie.alias("__tie"))
    lines = cut(rows.mapInArrow(line_hashes, LINES))

    counted = lines.groupBy("__host", "h", "__row").agg(F.lit(1)).groupBy(F.col("__host").alias("host"), "h").agg(F.count("*").alias("n"))
    frequent = counted.where(F.col("n") > max_docs).select(F.col("host").alias("fhost"), F.col("h").alias("fh"))
    held = cut(
        lines.join(frequent, F.col("__host").eqNullSafe(F.col("fhost")) & (F.col("h") == F.col("fh")))
        .groupBy(F.col("__row").alias("row"), F.col("__host").alias("host"), F.col("__tie").alias("tie"))
        .agg(F.collect_set("h").alias("__frequent"))
    )
    drop(lines)
    may_hold = maybe_in(held.select(F.xxhash64("row", "host", "tie").alias("key")))(F.xxhash64("__row", "__host", "__tie"))
    same = F.col("__row").eqNullSafe(F.col("row")) & F.col("__host").eqNullSafe(F.col("host")) & (F.col("__tie") == F.col("tie"))
    # joined by sorting whatever the size of held, so that what a small table costs is what a large one does
    with_lines = rows.where(may_hold).join(held.hint("merge"), same, "left").select("__row", "__text", "__frequent")
    without = rows.where(~may_hold).select("__row", "__text", F.lit(None).cast("array<bigint>").alias("__frequent"))
    found = with_lines.unionAll(without).mapInArrow(lambda batches: features(batches, window), FEATURES)
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    left = F.col("n_words") - F.col("lost_words")
    depleted = (F.col("lost_words") > 0) & ((F.col("lost_words") > max_lost * F.col("n_words")) | (left < min_words))
    return found.select(
        F.col("__row").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & ~depleted).alias("kept"), "lost_lines", "lost_words", "removed", F.col("__clean").alias(text_col),
    )


def line_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """The rows of ``clean_texts`` with text_crc32, the checksum of the text without its frequent lines, in place of that text."""
    out = clean_texts(docs, id_col, text_col, **rules)
    return out.select(*(c for c in out.columns if c != text_col), F.crc32(F.col(text_col).cast("binary")).alias("text_crc32"))
