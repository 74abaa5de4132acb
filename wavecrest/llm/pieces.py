"""Sampled segmentations of text into the pieces of a SentencePiece model, and decoding.

A text's lattice has a place at every byte and an edge for every piece that matches there; characters that are no piece by themselves go
byte by byte. Forward filtering sums the weights of all paths to each place, backward sampling draws one path, piece by piece, with the
probability of its product of weights. Draws come from a hash of (seed, row key, unit, step), so a row's segmentation is the same in any
batch, partition or run. Spaces are kept as the model's space mark, a mark in the text itself goes byte by byte, and nothing is
normalised, so decoding gives back every text.

No piece crosses from one word to the next or a line feed, so a lattice is a chain of independent units (a word with the spaces before it, or a
line feed), and sampling unit by unit is the same as sampling the whole.

Scale: one pass over whole texts without a shuffle. Lattices of the units met so far are kept, up to ``max_edges`` edges, and
all units of some megabytes of text are drawn together, one piece a step.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecrest.llm.words import BYTE_KEYS, Texts, chunks, mix, place_keys

MARK = "▁"


class Pieces:
    """The pieces of a model, as bytes with plain spaces, with the logarithm of their weights."""

    def __init__(self, path: str, theta: float = 1.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        score = np.array([model.get_score(i) for i in range(n)])
        byte = [model.is_byte(i) for i in range(n)]
        plain = [not (b or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i, b in enumerate(byte)]
        if np.all(score == np.round(score)):  # merges in order, as in byte-pair models: weight falls with rank
            score = -np.log(2 - np.minimum(score, 0))
        self.log_weight = theta * score
        self.byte_ids = np.zeros(256, np.int64)
        self.bytes_of: list[bytes] = [b""] * n
        for i, name in enumerate(names):
            if byte[i]:
                self.byte_ids[int(name[1:-1], 16)] = i
                self.bytes_of[i] = bytes([int(name[1:-1], 16)])
            elif plain[i]:
                self.bytes_of[i] = name.replace(MARK, " ").encode()
                inner = self.bytes_of[i].lstrip(b" ")
                if b" " in inner or b"\n" in self.bytes_of[i]:
                    raise ValueError(f"piece {i} crosses words")
        if sum(byte) != 256:
            raise ValueError("a model with a piece for every byte is needed")
        self.n = n
        # of each length the sorted hashes of what pieces begin with, and the piece that this is, or -1: a place where no piece begins so is done
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        ids = np.array([i for i in range(n) if plain[i] and self.bytes_of[i]])
        lengths = np.array([len(self.bytes_of[i]) for i in ids])
        data = np.frombuffer(b"".join(self.bytes_of[i] for i in ids), np.uint8)
        first, acc = np.cumsum(lengths) - lengths, np.zeros(len(ids), np.uint64)
        for k in range(1, int(lengths.max()) + 1):
            keep = lengths >= k
            ids, lengths, first, acc = ids[keep], lengths[keep], first[keep], acc[keep]
            acc = acc + BYTE_KEYS[data[first + k - 1]] * place_keys(k)[k - 1]
            h = mix(acc + np.uint64(k))
            hashes, whole = np.unique(h), lengths == k
            piece = np.full(len(hashes), -1)
            piece[np.searchsorted(hashes, h[whole])] = ids[whole]
            self.tables[k] = hashes, piece
        self.longest = max(self.tables)
        self.lengths = np.array([len(b) for b in self.bytes_of])
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.at = np.cumsum(self.lengths) - self.lengths

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for."""
        length = self.lengths[ids]
        first = np.cumsum(length) - length
        return self.flat[np.repeat(self.at[ids] - first, length) + np.arange(int(length.sum()))]


class Sampler:
    """Draws segmentations. Lattices of units met so far are kept in arrays made once. Above ``max_edges`` edges all are forgotten before
    the next texts; the arrays have room for the new units of some texts beyond that, and grow only for a text that has more of them."""

    #: Bytes of new units whose lattices are built at once; a longer unit is built alone.
    LEARN_BYTES = 1 << 16

    def __init__(self, pieces: Pieces, seed: int = 0, max_edges: int = 1_500_000):
        self.pieces, self.seed, self.max_edges = pieces, seed, max_edges
        self.reach = np.zeros(0, np.uint64)
        self._clear()

    def _room(self, edges: int) -> None:
        # edges in order of the state that they lead to: 2**32 * state + cumulative probability; the state they come from, or -1 if it is a start; piece
        self.reach = np.zeros(edges, np.uint64)
        self.source = np.zeros(edges, np.int32)
        self.token = np.zeros(edges, np.int32)

    def _clear(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted hashes of units, and the end state of each
        self.end_of = np.zeros(0, np.int64)
        self.states = self.edges = 0
        if len(self.reach) != self.max_edges * 5 // 4:
            self._room(self.max_edges * 5 // 4)

    def units(self, texts: Texts) -> np.ndarray:
        """Where units begin: at the first space of a run of spaces, at a line feed and behind it, and with each text."""
        d = texts.data
        cut = np.zeros(len(d) + 1, bool)
        space, line = d == 0x20, d == 0x0A
        cut[1:-1] = space[1:] & ~space[:-1]
        cut[:-1] |= line
        cut[1:] |= line
        cut[texts.offsets] = True
        return np.flatnonzero(cut[:-1])

    def _lattice(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Edges (from, to, piece) of units end to end; unit i is data[first[i]:first[i + 1]], with one state more than bytes."""
        n, lengths = len(data), np.diff(first)
        ends = np.repeat(first[1:], lengths)
        head = np.append(data & 0xC0 != 0x80, True)
        at = np.flatnonzero(head[:-1])
        acc = np.zeros(len(at), np.uint64)
        place = place_keys(self.pieces.longest)
        froms, tos, tokens = [], [], []
        single = np.zeros(n, bool)
        width = np.diff(np.append(at, n))  # bytes of each character; units end between characters
        for k in range(1, self.pieces.longest + 1):
            keep = at + k <= ends[at]
            at, acc, width = at[keep], acc[keep], width[keep]
            if not len(at):
                break
            acc = acc + BYTE_KEYS[data[at + k - 1]] * place[k - 1]
            hashes, ids = self.pieces.tables[k]
            h = mix(acc + np.uint64(k))
            i = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            keep = hashes[i] == h
            at, acc, width, found = at[keep], acc[keep], width[keep], ids[i[keep]]
            hit = np.flatnonzero(found >= 0)
            froms.append(at[hit])
            tos.append(at[hit] + k)
            tokens.append(found[hit])
            single[at[hit[width[hit] == k]]] = True
        chars = np.flatnonzero(head[:-1])
        bare = chars[~single[chars]]
        size = np.diff(np.append(chars, n))[~single[chars]]
        one = np.repeat(bare - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        froms.append(one)
        tos.append(one + 1)
        tokens.append(self.pieces.byte_ids[data[one]])
        return np.concatenate(froms), np.concatenate(tos), np.concatenate(tokens)

    def _learn(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Adds the lattices of new units; returns their end states."""
        unit_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        a, b, token = self._lattice(data, first)
        unit = unit_of[a]
        a_state, b_state, place = a + unit, b + unit, b - first[unit]
        # places in turn; in a place by the state that edges lead to, then by the one they come from
        longest = self.pieces.longest
        order = np.argsort((place * (len(data) + len(first)) + b_state) * (longest + 1) + longest - (b - a))
        a_o, b_o, place_o, w = a_state[order], b_state[order], place[order], self.pieces.log_weight[token[order]]
        total = np.zeros(len(data) + len(first) - 1)
        share = np.empty(len(order))
        bounds = np.append(np.flatnonzero(np.diff(place_o, prepend=-1)), len(order))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            v = total[a_o[lo:hi]] + w[lo:hi]
            to = b_o[lo:hi]
            start = np.flatnonzero(np.diff(to, prepend=-1))
            top = np.maximum.reduceat(v, start)
            n = np.diff(np.append(start, hi - lo))
            e = np.exp(v - np.repeat(top, n))
            s = np.add.reduceat(e, start)
            total[to[start]] = top + np.log(s)
            cum = np.cumsum(e)
            base = cum[start] - e[start]
            share[lo:hi] = (cum - np.repeat(base, n)) / np.repeat(s, n)
            share[lo + np.append(start[1:], hi - lo) - 1] = 1.0
        by_state = np.argsort(b_o, kind="stable")
        starts = (first[:-1] + np.arange(len(first) - 1))
        is_start = np.zeros(len(total), bool)
        is_start[starts] = True
        source = a_o[by_state]
        size = self.edges + len(source)
        if size > len(self.reach):
            kept = self.reach, self.source, self.token
            self._room(size)
            for old, new in zip(kept, (self.reach, self.source, self.token), strict=True):
                new[: self.edges] = old[: self.edges]
        new = slice(self.edges, size)
        self.reach[new] = ((self.states + b_o[by_state]).astype(np.uint64) << np.uint64(32)) + (share[by_state] * 2.0**32).astype(np.uint64)
        self.source[new] = np.where(is_start[source], -1, self.states + source)
        self.token[new] = token[order][by_state]
        ends = self.states + first[1:] + np.arange(len(first) - 1)
        self.states += len(total)
        self.edges = size
        return ends

    def _lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The end state of each unit; hashes ascend."""
        if self.edges > self.max_edges:
            self._clear()
        at = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != hashes[inside]
        length = (ends - starts)[new]
        if len(length):
            a, b = starts[new], np.zeros(len(length), np.int64)
            part = np.cumsum(length) // self.LEARN_BYTES
            for k in np.unique(part):
                some = slice(*np.searchsorted(part, [k, k + 1]))
                n = length[some]
                first = np.concatenate([[0], np.cumsum(n)])
                b[some] = self._learn(data[np.repeat(a[some] - first[:-1], n) + np.arange(first[-1])], first)
            self.end_of = np.insert(self.end_of, at[new], b)
            self.known = np.insert(self.known, at[new], hashes[new])
        return self.end_of[np.searchsorted(self.known, hashes)]

    def encode(self, column: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all texts end to end, and the number of each text's. keys: 64-bit key of each text's draws."""
        texts = Texts(column)
        data = texts.data
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(texts.n, np.int64)
        starts = self.units(texts)
        ends = np.append(starts[1:], len(data))
        unique, where, inverse = np.unique(texts.hash_spans(starts, ends), return_index=True, return_inverse=True)
        state = self._lookup(data, starts[where], ends[where], unique)[inverse]
        text = texts.text_of(starts)
        order_in_text = (np.arange(len(starts)) - np.searchsorted(starts, texts.offsets)[text]).astype(np.uint64)
        draw = mix(keys[text] + mix(order_in_text + np.uint64(self.seed * 0x10001 + 1)))
        counts = np.zeros(len(starts), np.int64)
        alive = np.argsort(state, kind="stable")  # like units side by side, so that their edges are
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        while len(alive):
            step = np.uint64((len(taken) + 1) * 0x9E3779B97F4A7C15 % 2**64)
            u = mix(draw[alive] + step) >> np.uint64(32)
            edge = np.searchsorted(self.reach[: self.edges], (state[alive].astype(np.uint64) << np.uint64(32)) + u, "right")
            taken.append((alive, self.token[edge]))
            counts[alive] += 1
            back = self.source[edge]
            state[alive] = back
            alive = alive[back >= 0]
        last = np.cumsum(counts) - 1
        out = np.empty(int(counts.sum()), np.int32)
        for k, (which, token) in enumerate(taken):
            out[last[which] - k] = token
        bounds = np.concatenate([[0], last + 1])[np.searchsorted(starts, texts.offsets)]
        return out, np.diff(bounds)


_pieces: dict[tuple, Pieces] = {}


def loaded(path: str, theta: float = 1.0) -> Pieces:
    """The pieces of a model, kept by the worker; only one model's at a time."""
    if (path, theta) not in _pieces:
        _pieces.clear()
        _pieces[path, theta] = Pieces(path, theta)
    return _pieces[path, theta]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", theta: float = 1.0, seed: int = 0, keep: list[str] | None = None) -> DataFrame:
    """Returns a row per row of docs: id_col (and the columns ``keep``), n_pieces, ids (array of int) and text_crc32 (of the text in UTF-8).

    ``theta`` scales the logarithms of the weights: 0 draws all segmentations alike, large values nearly always the best. A piece's weight
    is its score in the model; in a byte-pair model, whose scores are ranks, it falls with rank. Draws depend on the row's id alone, so
    rows that repeat an id and a text repeat its pieces; null ids share a key. Null and empty texts have no pieces. Other columns are ignored."""
    kept = keep or []
    rows = docs.select(F.col(id_col).cast("bigint").alias("__id"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(kept)], F.col(text_col).alias("__text"))
    passed = [c for c in rows.columns if c != "__text"]
    schema = rows.select(*passed, F.lit(0).cast("bigint").alias("n_pieces"), F.array().cast("array<int>").alias("ids"), F.lit(0).cast("bigint").alias("text_crc32")).schema

    def run(batches):
        draws = Sampler(loaded(model, theta), seed)  # a task's own, so that an idle worker keeps no lattices
        for batch in batches:
            for part in chunks(batch, "__text", 1 << 19):
                texts = part.column("__text").cast(pa.large_string()).fill_null("")
                row_keys = mix(part.column("__id").fill_null(-1).to_numpy().view(np.uint64))
                ids, n = draws.encode(texts, row_keys)
                crc = pa.array([zlib.crc32(x.as_buffer() if x.is_valid else b"") for x in texts.cast(pa.large_binary())], pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in passed), pa.array(n), lists, crc], [*passed, "n_pieces", "ids", "text_crc32"])

    out = rows.mapInArrow(run, schema)
    return out.withColumnsRenamed({"__id": id_col} | {f"__k{i}": c for i, c in enumerate(kept)})


def decode(encoded: DataFrame, model: str, ids_col: str = "ids", text: bool = True) -> DataFrame:
    """encoded with the text that ids_col stands for (``decoded``, if asked for) and its crc32 (``decoded_crc32``); null for null ids."""
    columns = encoded.columns
    schema = encoded.withColumn("decoded", F.lit("x").cast("string")).withColumn("decoded_crc32", F.lit(0).cast("bigint"))
    schema = (schema if text else schema.drop("decoded")).schema

    def run(batches):
        pieces = loaded(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column(ids_col)
                n = np.asarray(ids.value_lengths().fill_null(0))
                flat = pieces.decode(ids.flatten().to_numpy())
                length = pieces.lengths[ids.flatten().to_numpy()]
                ends = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(n)])].tolist()
                parts = [flat[a:b].tobytes() if ok else None for a, b, ok in zip(ends, ends[1:], ids.is_valid().to_pylist(), strict=False)]
                more = [pa.array([None if p is None else p.decode() for p in parts], pa.string())] if text else []
                crc = pa.array([None if p is None else zlib.crc32(p) for p in parts], pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *more, crc], [*columns, *(["decoded"] if text else []), "decoded_crc32"])

    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, model: str, **options) -> DataFrame:
    """What encode returns, and ``lossless``: whether decoding the pieces gives the text's checksum."""
    back = decode(encode(docs, model, **options), model, text=False)
    return back.withColumn("lossless", F.col("text_crc32") == F.col("decoded_crc32")).drop("decoded_crc32")
