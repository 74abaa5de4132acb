"""Token ids in binary files of compressed bit or byte planes.

A file holds ids of documents in ascending order of document id, in blocks of a fixed number of ids. A block is transposed into
planes (plane k holds bit k, or byte k, of every id), each plane is compressed with zstandard, and an index at the end of the
file gives each block's place, so that a reader finds any range of ids without reading what is before it.

File: MAGIC; the planes of all blocks; then, compressed, the document index (ids and lengths, signed 64-bit); then the chunk
index: per block its offset, number of ids, kind (0 bits, 1 bytes), number of planes, and the compressed length of each plane
(unsigned 64-bit); then a footer: places and lengths of both indexes, numbers of documents and ids (unsigned 64-bit), MAGIC. All little-endian.

Scale: documents are dealt by ranges of their id; each task streams its range into one file and holds one block and one chunk of texts at
a time. Only one row per file (its counts) is gathered, to give each file its first position. A task that runs anew writes under
another name and then takes the same final name, so lost executors leave no torn file.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecrest.llm.shared import folder, move, open_input, open_output
from wavecrest.llm.words import Texts, chunks

MAGIC = b"BITPLN1\n"
FOOTER = struct.Struct("<6Q8s")
MANIFEST = "part int, file string, n_docs bigint, n_ids bigint"


def split_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, lowest first; planes above the highest that is used are left out."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    if kind == "byte":
        table = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
        return [np.ascontiguousarray(table[:, k]).tobytes() for k in range(-(-top // 8))]
    return [np.packbits(((ids >> np.uint32(k)) & np.uint32(1)).astype(np.uint8), bitorder="little").tobytes() for k in range(top)]


def join_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    ids = np.zeros(n, np.uint32)
    for k, plane in enumerate(planes):
        if kind == "byte":
            ids |= np.frombuffer(plane, np.uint8).astype(np.uint32) << np.uint32(8 * k)
        else:
            ids |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little").astype(np.uint32) << np.uint32(k)
    return ids


class PlaneWriter:
    def __init__(self, stream, block: int = 1 << 16, kind: str = "bit", level: int = 3):
        self.stream, self.block, self.kind = stream, block, kind
        self.pack = zstandard.ZstdCompressor(level=level)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.index: list[int] = []
        self.doc_ids: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        stream.write(MAGIC)
        self.at = len(MAGIC)

    def add(self, doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_ids.astype("<i8"))
        self.lengths.append(lengths.astype("<i8"))
        self.held.append(ids.astype(np.uint32))
        self.n_held += len(ids)
        if self.n_held >= self.block:
            all_ids = np.concatenate(self.held)
            full = len(all_ids) // self.block * self.block
            for i in range(0, full, self.block):
                self._flush(all_ids[i : i + self.block])
            self.held = [all_ids[full:]]
            self.n_held = len(all_ids) - full

    def _put(self, data: bytes) -> int:
        self.stream.write(data)
        self.at += len(data)
        return len(data)

    def _flush(self, ids: np.ndarray) -> None:
        planes = [self.pack.compress(p) for p in split_planes(ids, self.kind)]
        self.index += [self.at, len(ids), int(self.kind == "byte"), len(planes), *map(len, planes)]
        for p in planes:
            self._put(p)
        self.n_ids += len(ids)

    def close(self) -> tuple[int, int]:
        rest = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        if len(rest):
            self._flush(rest)
        none = np.zeros(0, "<i8")
        docs = np.concatenate([*self.doc_ids, none, *self.lengths])
        doc_at, doc_len = self.at, self._put(self.pack.compress(docs.tobytes()))
        chunk_at, chunk_len = self.at, self._put(self.pack.compress(np.array(self.index, "<u8").tobytes()))
        self._put(FOOTER.pack(doc_at, doc_len, chunk_at, chunk_len, len(docs) // 2, self.n_ids, MAGIC))
        self.stream.close()
        return len(docs) // 2, self.n_ids


class PlaneReader:
    def __init__(self, source):
        self.source = source
        size = source.size()
        doc_at, doc_len, chunk_at, chunk_len, self.n_docs, self.n_ids, magic = FOOTER.unpack(self._get(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC or self._get(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a file of planes")
        self.unpack = zstandard.ZstdDecompressor()
        docs = np.frombuffer(self.unpack.decompress(self._get(doc_at, doc_len)), "<i8")
        self.doc_ids, self.lengths = docs[: self.n_docs], docs[self.n_docs :]
        flat = np.frombuffer(self.unpack.decompress(self._get(chunk_at, chunk_len)), "<u8").tolist()
        self.chunks: list[tuple[int, int, int, list[int]]] = []
        i = 0
        while i < len(flat):
            at, n, kind, planes = flat[i : i + 4]
            self.chunks.append((at, n, kind, flat[i + 4 : i + 4 + planes]))
            i += 4 + planes
        self.first = np.concatenate([[0], np.cumsum([c[1] for c in self.chunks])]).astype(np.int64)

    def _get(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def chunk(self, k: int) -> np.ndarray:
        at, n, kind, lengths = self.chunks[k]
        data = self._get(at, sum(lengths))
        ends = np.cumsum([0, *lengths]).tolist()
        planes = [self.unpack.decompress(data[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        return join_planes(planes, n, "byte" if kind else "bit")

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from position ``start`` of the file."""
        k = int(np.searchsorted(self.first, start, "right")) - 1
        out = []
        while n > 0 and k < len(self.chunks):
            part = self.chunk(k)[start - int(self.first[k]) :][:n]
            out.append(part)
            start, n, k = start + len(part), n - len(part), k + 1
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def documents(self) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        """Position, number and pieces of the ids of each document, in order; holds one block, and one document in pieces."""
        at, k, block, used = 0, -1, np.zeros(0, np.uint32), 0
        for n in self.lengths.tolist():
            pieces, need = [], n
            while need:
                if used == len(block):
                    k, used = k + 1, 0
                    block = self.chunk(k)
                take = block[used : used + need]
                pieces.append(take)
                used, need = used + len(take), need - len(take)
            yield at, n, pieces
            at += n


class UnitEncoder:
    """Encodes texts with a byte-level tokenizer, remembering what short units of text give.

    Byte-level pre-tokenisation never joins across a lone space between two characters that are not white space (the
    space goes with what follows), between a letter and a full stop or the like, or after a lone line feed. So a text's ids
    are those of its parts between such places. A part is met again and again, and only new ones go through the tokenizer.
    Cuts are made at bytes of which that is certain: printable ASCII, and two-byte characters from U+00C0 on.
    """

    FIRST = np.zeros(256, bool)
    FIRST[0x21:0x7F] = FIRST[0xC3:0xE0] = True
    STOP = np.zeros(256, bool)
    STOP[list(b".,!?;:")] = True
    LETTER = np.zeros(256, bool)
    LETTER[65:91] = LETTER[97:123] = True

    def __init__(self, path: str, most: int = 3_000_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted hashes of units, of which unit i's ids are flat[at[i]:][:length[i]]
        self.at = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of each text's."""
        texts = Texts(column)
        data = texts.data
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(texts.n, np.int64)
        cut = np.zeros(len(data), bool)
        sp = np.flatnonzero((data[2:-1] == 0x20) | (data[2:-1] == 0x0A)) + 2
        before, line = data[sp - 1], data[sp] == 0x0A
        plain = (before > 0x20) & (before < 0x7F)
        two = (before >= 0x80) & (data[sp - 2] >= 0xC3) & (data[sp - 2] < 0xE0)
        sure = (plain | two) & self.FIRST[data[sp + 1]]
        cut[sp[sure]] = True
        cut[sp[sure & line] + 1] = True
        stop = np.flatnonzero(self.STOP[data[2:]]) + 2
        before = data[stop - 1]
        cut[stop[self.LETTER[before] | ((before >= 0x80) & (data[stop - 2] == 0xC3) & (before != 0x97) & (before != 0xB7))]] = True
        inner = texts.offsets[(texts.offsets > 0) & (texts.offsets < len(data))]
        cut[inner - 1] = False  # what ends a text has nothing after it, so nothing is certain there
        cut[np.minimum(inner + 1, len(data) - 1)] &= data[np.minimum(inner, len(data) - 1)] != 0x0A  # nor after a line feed that begins one
        cut[texts.offsets[:-1][texts.offsets[:-1] < len(data)]] = True  # but each text begins a unit
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        hashes = texts.hash_spans(starts, ends)
        unique, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(unique) > self.most:
            self._clear()
        at = np.searchsorted(self.known, unique)
        new = np.ones(len(unique), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != unique[inside]
        if new.any():
            units = [data[a:b].tobytes().decode() for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
            length = np.array([len(x) for x in ids], np.int64)
            flat = np.fromiter((i for x in ids for i in x), np.uint32, int(length.sum()))
            place = len(self.flat) + np.cumsum(length) - length
            self.flat = np.concatenate([self.flat, flat])
            self.at = np.insert(self.at, at[new], place)
            self.length = np.insert(self.length, at[new], length)
            self.known = np.insert(self.known, at[new], unique[new])
        slot = np.searchsorted(self.known, unique)[inverse]
        length = self.length[slot]
        first = np.cumsum(length) - length
        out = self.flat[np.repeat(self.at[slot] - first, length) + np.arange(int(length.sum()))]
        ends_of_units = np.concatenate([[0], np.cumsum(length)])
        bounds = ends_of_units[np.searchsorted(starts, texts.offsets)]
        return out, np.diff(bounds)


_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]


def append_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> np.ndarray:
    """The ids with end_id after those of each text."""
    return np.insert(ids, np.cumsum(counts), np.uint32(end_id))


def write_token_files(
    docs: DataFrame,
    target: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    block: int = 1 << 16,
    kind: str = "bit",
    partitions: int | None = None,
) -> DataFrame:
    """Writes the ids of every text, each document closed by end_id, to files below ``target`` (a path that all executors
    see), in ascending order of id over all files; returns the manifest (part, file, n_docs, n_ids), itself written there.

    Null and empty texts have the end id alone. Null ids come first; rows that repeat an id follow each other, ordered by
    text. An empty table gives an empty manifest. Other columns are not read."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("__id"), F.col(text_col).alias("__text"))
    by = [partitions, "__id"] if partitions else ["__id"]
    rows = rows.repartitionByRange(*by).sortWithinPartitions("__id", "__text")

    def write(batches):
        part = TaskContext.get().partitionId()
        final = f"{target}/ids-{part:06d}.planes"
        writing, writer = f"{final}.{uuid.uuid4().hex}.part", None
        codes = encoder(tokenizer)
        for batch in batches:
            for piece in chunks(batch, "__text", 4 << 20):
                if writer is None:
                    writer = PlaneWriter(open_output(writing), block, kind)
                ids, counts = codes.encode(piece.column("__text"))
                doc_ids = piece.column("__id").fill_null(-(2**63)).to_numpy()
                writer.add(doc_ids, counts + 1, append_end(ids, counts, end_id))
        if writer is not None:
            n_docs, n_ids = writer.close()
            move(writing, final)
            yield pa.RecordBatch.from_pylist([{"part": part, "file": final, "n_docs": n_docs, "n_ids": n_ids}], schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    rows.mapInArrow(write, MANIFEST).write.parquet(f"{target}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{target}/manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """A row per document of the files: doc_id, start (ids of all documents before it, over all files), n_tokens and
    ids_crc32 (of its ids as little-endian unsigned 32-bit integers). A file is read by one task, block by block."""
    spark = manifest.sparkSession
    files = sorted(manifest.select("part", "file", "n_ids").collect())  # one row per file
    first, rows = 0, []
    for part, file, n in files:
        rows.append((part, file, first))
        first += n
    listed = spark.createDataFrame(rows, "part int, file string, first bigint").repartition(max(1, len(rows)), "part")

    def read(batches):
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist(), strict=True):
                with open_input(file) as source:
                    reader = PlaneReader(source)
                    held: list[tuple[int, int, int, int]] = []
                    for doc_id, (at, n, pieces) in zip(reader.doc_ids.tolist(), reader.documents(), strict=True):
                        crc = 0
                        for p in pieces:
                            crc = zlib.crc32(p.astype("<u4").tobytes(), crc)
                        held.append((doc_id, base + at, n, crc))
                        if len(held) == 10_000:
                            yield _rows(held)
                            held = []
                    if held:
                        yield _rows(held)

    return listed.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _rows(held: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    doc_id, *rest = (np.array(c, np.int64) for c in zip(*held, strict=True))
    ids = pa.array(doc_id, mask=doc_id == -(2**63))
    return pa.RecordBatch.from_arrays([ids, *map(pa.array, rest)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_files(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes the files to a new place in the shared folder and reads them back."""
    return read_token_files(write_token_files(docs, folder(docs.sparkSession), tokenizer, **options))
