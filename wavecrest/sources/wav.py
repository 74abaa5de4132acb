"""WAV files as rows and rows as WAV files.

Files come in through Spark's binaryFile source, one row each, and are parsed in Arrow batches; the sink side makes one BINARY value per row.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

PCM, FLOAT, ALAW, ULAW, EXTENSIBLE = 1, 3, 6, 7, 0xFFFE
CLIP = "path string, sr int, ch int, pcm array<float>"


def ulaw_table() -> np.ndarray:
    """The 256 values of mu-law, in [-1, 1]: sign, 3 bits of exponent, 4 of mantissa, all inverted."""
    u = ~np.arange(256, dtype=np.uint8)
    size = (((u & 15).astype(int) << 3) + 132 << ((u >> 4) & 7).astype(int)) - 132
    return np.where(u & 128, -size, size) / 32768


def alaw_table() -> np.ndarray:
    """The 256 values of A-law, in [-1, 1]: every other bit inverted, sign, exponent, mantissa."""
    a = np.arange(256, dtype=np.uint8) ^ 0x55
    e, m = ((a >> 4) & 7).astype(int), (a & 15).astype(int)
    size = np.where(e == 0, (m << 4) + 8, ((m << 4) + 264) << np.maximum(e - 1, 0))
    return np.where(a & 128, size, -size) / 32768


def decode_samples(data: bytes, kind: int, bits: int) -> np.ndarray:
    """Samples in [-1, 1] of 8 to 32 bit integers, floats, A-law or mu-law; what is left of a broken sample is dropped."""
    width = bits // 8
    raw = np.frombuffer(data[: len(data) // width * width], np.uint8)
    if kind in (ALAW, ULAW):
        return (alaw_table() if kind == ALAW else ulaw_table())[raw].astype(np.float32)
    if kind == FLOAT:
        return raw.view("<f4" if bits == 32 else "<f8").astype(np.float32)
    if bits == 8:
        return ((raw.astype(np.float64) - 128) / 128).astype(np.float32)
    if bits == 24:
        b = raw.reshape(-1, 3).astype(np.int32)
        v = (b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8
    else:
        v = raw.view(f"<i{width}")
    return (v / 2.0 ** (bits - 1)).astype(np.float32)


def parse_wav(data: bytes) -> tuple[int, int, np.ndarray] | None:
    """Rate, channels and interleaved samples; None if data is no WAV file. Chunks are aligned to words; a data chunk that breaks off is
    read as far as it goes."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            kind, ch, sr, _, _, bits = struct.unpack_from("<HHIIHH", body)
            if kind == EXTENSIBLE and len(body) >= 26:
                kind = struct.unpack_from("<H", body, 24)[0]
            form = (kind, ch, sr, bits)
        elif name == b"data" and form:
            kind, ch, sr, bits = form
            legal = {PCM: (8, 16, 24, 32), FLOAT: (32, 64), ALAW: (8,), ULAW: (8,)}.get(kind, ())
            if bits not in legal or not ch:
                return None
            pcm = decode_samples(body, kind, bits)
            return sr, ch, pcm[: len(pcm) // ch * ch]
        at += 8 + size + (size & 1)
    return None


def make_wav(pcm: np.ndarray, sr: int, ch: int, bits: int = 16, is_float: bool = False) -> bytes:
    """A WAV file; depths that don't exist fall back to 16 bit integers, or 32 bit floats."""
    if is_float:
        bits = bits if bits in (32, 64) else 32
        body = np.asarray(pcm).astype("<f4" if bits == 32 else "<f8").tobytes()
    else:
        bits = bits if bits in (8, 16, 24, 32) else 16
        x = np.clip(np.asarray(pcm, np.float64), -1, 1) * (2 ** (bits - 1) - 1)
        v = (np.sign(x) * np.floor(np.abs(x) + 0.5)).astype(np.int64)
        if bits == 8:
            body = (v + 128).astype(np.uint8).tobytes()
        else:
            body = v.astype("<i4").view(np.uint8).reshape(-1, 4)[:, : bits // 8].tobytes()
    head = struct.pack("<4sIHHIIHH", b"fmt ", 16, FLOAT if is_float else PCM, ch, sr, sr * ch * bits // 8, ch * bits // 8, bits)
    tail = b"\0" if len(body) & 1 else b""
    return b"RIFF" + struct.pack("<I", 4 + len(head) + 8 + len(body) + len(tail)) + b"WAVE" + head + struct.pack("<4sI", b"data", len(body)) + body + tail


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """path, sr, ch, pcm of each WAV file below a path; sr, ch and pcm are null for others. A file is one row of bytes, and a task holds some
    copies of it, so files of over 2 GB can't be read; cut long recordings into clips first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            found = [parse_wav(x) if x is not None else None for x in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("path"),
                    pa.array([f and f[0] for f in found], pa.int32()),
                    pa.array([f and f[1] for f in found], pa.int32()),
                    pa.array([None if f is None else f[2] for f in found], pa.list_(pa.float32())),
                ],
                ["path", "sr", "ch", "pcm"],
            )

    return files.mapInArrow(run, CLIP)


def to_wav(clips: DataFrame, bits: int = 16, is_float: bool = False) -> DataFrame:
    """path and content (a WAV file) of clips (path, sr, ch, pcm); null for null clips."""

    def run(batches):
        for batch in batches:
            made = [
                None if pcm is None or sr is None or ch is None else make_wav(pcm, sr, ch, bits, is_float)
                for sr, ch, pcm in zip(*(batch.column(c).to_pylist() for c in ("sr", "ch", "pcm")), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(made, pa.binary())], ["path", "content"])

    return clips.select("path", "sr", "ch", "pcm").mapInArrow(run, "path string, content binary")
