"""Words of many texts at once, over UTF-8 bytes in numpy.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed
and carriage return: ``[^\\x20\\x09-\\x0D]+``. No byte of a multi-byte character
is one of these, so working on bytes is exact. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit words that spreads every bit."""
    x = np.array(x, np.uint64, ndmin=1)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def keys(n: int, seed: int) -> np.ndarray:
    """n fixed odd pseudo-random 64-bit words."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) + (np.uint64(seed) << np.uint64(32))) | np.uint64(1)


BYTE_KEYS = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x51ED2701))
_place_keys = keys(1 << 10, 7)


def place_keys(n: int) -> np.ndarray:
    global _place_keys
    if n > len(_place_keys):
        return keys(n, 7)
    return _place_keys[:n]


class Texts:
    """The bytes of some texts end to end; text i is data[offsets[i]:offsets[i + 1]]."""

    def __init__(self, column: pa.Array | list, lower: bool = False):
        if not isinstance(column, pa.Array):
            column = pa.array(column, pa.large_string())
        column = column.cast(pa.large_string())
        if column.null_count:
            column = column.fill_null("")
        self.n = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + self.n + 1]
        values = column.buffers()[2]
        data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
        self.data = data[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        if lower:
            self.data = LOWER[self.data]

    def segments(self, breaks: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of ``inside`` that neither cross a text's end nor start anew except at ``breaks``."""
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        if len(inside):
            before[breaks[breaks < len(inside)]] = False
            after[breaks[breaks > 0] - 1] = False
        return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1

    def words(self) -> Words:
        starts, ends = self.segments(self.offsets, ~SPACE[self.data])
        return Words(self, starts, ends)

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, places, "right") - 1

    def hash_spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each span of bytes; spans ascend and don't overlap."""
        lengths = ends - starts
        out = np.zeros(len(starts), np.uint64)
        full = np.flatnonzero(lengths > 0)
        if len(full):
            length = lengths[full]
            first = np.cumsum(length) - length
            place = np.arange(int(length.sum())) - np.repeat(first, length)
            values = BYTE_KEYS[self.data[place + np.repeat(starts[full], length)]]
            values *= place_keys(int(length.max()))[place]
            out[full] = np.add.reduceat(values, first)
        return mix(out + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Words:
    """The words of some texts; those of text i are first[i] to first[i + 1]."""

    def __init__(self, texts: Texts, starts: np.ndarray, ends: np.ndarray):
        self.texts, self.starts, self.ends = texts, starts, ends
        self.first = np.searchsorted(starts, texts.offsets)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return self.texts.hash_spans(self.starts, self.ends)

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of ``size`` words of a text, and where the windows of each text begin."""
        n = len(hashes) - size + 1
        counts = np.maximum(self.counts - size + 1, 0)
        first = np.concatenate([[0], np.cumsum(counts)])
        if n <= 0 or not first[-1]:
            return np.zeros(0, np.uint64), first
        total = np.zeros(n, np.uint64)
        for j, key in enumerate(keys(size, 11)):
            total += hashes[j : j + n] * key
        at = np.arange(first[-1]) - np.repeat(first[:-1], counts) + np.repeat(self.first[:-1], counts)
        return mix(total[at]), first

    def shingles(self, hashes: np.ndarray, size: int) -> Iterator[np.ndarray]:
        """The sorted set of shingle hashes of each text. A text of fewer words has its whole sequence as the one
        shingle, a text without words none."""
        windows, first = self.windows(hashes, size)
        short = keys(size, 13)
        for i, n in enumerate(self.counts):
            if n >= size:
                yield np.unique(windows[first[i] : first[i + 1]])
            elif n:
                part = hashes[self.first[i] : self.first[i + 1]]
                yield mix((part * short[:n]).sum(dtype=np.uint64) + np.uint64(n))
            else:
                yield np.zeros(0, np.uint64)


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold about ``limit`` bytes, or one longer text."""
    start = total = 0
    for i, size in enumerate(_sizes(batch.column(column)).tolist()):
        if i > start and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def _sizes(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
