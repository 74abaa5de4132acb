"""WARC archives without repeated payloads.

Payload digests are grouped, one response of each digest keeps its payload, every other record becomes a revisit record that
refers to it, and archives are written with fresh headers, one gzip member per record. Reading back joins revisits to their responses.

Scale: only headers (key, URI, digest, length) are shuffled: those of one digest are summed to their largest key with a partial
aggregate, and joined back, where adaptive execution splits a digest that many pages share. Revisit records are written from headers alone.
Payloads are written where they lie by all rows that can't be a revisit, as a table of bits of fixed size tells; the few that it can't
tell are looked up exactly. Each task streams its rows into one file at a time, and starts another at
``file_bytes``; each file is read by a task of its own, in pieces, and one record is held. A task that runs anew writes under other names
before it takes the same final ones.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecrest.llm.shared import cut, drop, folder, maybe_in, move, open_input, open_output

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6f1d7a53-2f0b-5a5e-9f0c-6c1b6f3f2a10")
MANIFEST = "part int, file string, n_records bigint, n_bytes bigint"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_id(key: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{key} {digest}')}>"


def header_value(text: str | None) -> str:
    """A value for one header line: line breaks and other controls are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in text or "")


def record(key: int | None, uri: str | None, payload: bytes, digest: str, original: int | None, date: str) -> bytes:
    """A WARC/1.1 record. With ``original`` (the key of the response of the same payload) it is a revisit, without a block."""
    revisit = original is not None
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(key, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {header_value(uri)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([] if key is None else [f"X-Record-Key: {key}"]),
        "Content-Type: text/html; charset=utf-8",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(original, digest)}"]
        payload = b""
    lines.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a file of gzip members, or of a plain file."""
    reader = _Pieces(stream)
    while True:
        head = reader.until(b"\r\n\r\n")
        if not head:
            return
        first, *lines = head.decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        block = reader.take(int(headers["content-length"]))
        if reader.take(4) != b"\r\n\r\n":
            raise ValueError("a record isn't closed by two line breaks")
        yield headers, block


class _Pieces:
    def __init__(self, stream, size: int = 1 << 20):
        self.stream, self.size, self.data, self.at, self.raw, self.inflate, self.plain = stream, size, b"", 0, b"", None, None

    def _more(self) -> bool:
        raw = self.raw or self.stream.read(self.size)
        self.raw = b""
        if not raw:
            return False
        if self.plain is None:
            self.plain = raw[:2] != b"\x1f\x8b"
        if self.plain:
            more = raw
        else:
            self.inflate = self.inflate or zlib.decompressobj(31)
            more = self.inflate.decompress(raw)
            if self.inflate.eof:
                self.raw, self.inflate = self.inflate.unused_data, None
        self.data = self.data[self.at :] + more
        self.at = 0
        return True

    def until(self, end: bytes) -> bytes:
        while (k := self.data.find(end, self.at)) < 0:
            if not self._more():
                if len(self.data) > self.at:
                    raise ValueError("a record's header breaks off")
                return b""
        out = self.data[self.at : k]
        self.at = k + len(end)
        return out

    def take(self, n: int) -> bytes:
        while len(self.data) - self.at < n:
            if not self._more():
                raise ValueError("a record's block breaks off")
        self.at += n
        return self.data[self.at - n : self.at]


def write_archives(
    pages: DataFrame,
    target: str,
    id_col: str = "page_id",
    uri_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 0,
    file_bytes: int = 256 << 20,
    date: str | None = None,
) -> DataFrame:
    """Writes one record per row of pages to archives below ``target`` (a path that all executors see) and returns the
    manifest (part, file, n_records, n_bytes), itself written there.

    The payload is the text in UTF-8, or the bytes of a binary column; null counts as empty. Of rows with equal payloads of at
    least ``min_bytes`` bytes, that with the largest id is a response and the others revisit it; smaller ones are all
    responses. Equal payloads are told by SHA-1 and length. Rows that repeat the largest id with an equal payload are all
    responses; a null id is smaller than any, and if all are null, all are responses. ``date`` is that of all records, by default the time of
    the call. An empty table gives an empty manifest."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("__id"), F.col(uri_col).cast("string").alias("__uri"), payload.alias("__payload"))
    rows = rows.withColumns({"__sha": F.unhex(F.sha1("__payload")), "__n": F.octet_length("__payload").cast("bigint")})
    headers = cut(rows.drop("__payload"))
    shared = (
        headers.where(F.col("__n") >= min_bytes)
        .groupBy("__sha", "__n")
        .agg(F.max("__id").alias("__original"), F.count("*").alias("__rows"))
        .where("__rows > 1 and __original is not null")
        .drop("__rows")
    )
    revisits = cut(headers.join(shared, ["__sha", "__n"]).where("not (__id <=> __original)"))

    # payloads of rows that may be a revisit by their bit, but are none
    row = F.xxhash64("__id", "__sha", "__n")
    may_revisit = maybe_in(revisits.select(row.alias("key")))
    names = ["__id", "__sha", "__n"]
    keys = revisits.select(*(F.col(c).alias(f"{c}r") for c in names))
    same = F.col("__id").eqNullSafe(F.col("__idr")) & (F.col("__sha") == F.col("__shar")) & (F.col("__n") == F.col("__nr"))
    doubtful = cut(headers.where(may_revisit(row)).join(keys, same, "left_anti").select(*(F.col(c).alias(f"{c}r") for c in names)).distinct())
    may_doubt = maybe_in(doubtful.select(F.xxhash64("__idr", "__shar", "__nr").alias("key")))
    rest = rows.where(may_doubt(row)).join(doubtful, same, "left_semi")

    original = F.lit(None).cast("bigint").alias("__original")
    responses = rows.where(~may_revisit(row)).unionAll(rest).select("__id", "__uri", "__sha", "__payload", original)
    rows = responses.unionAll(revisits.select("__id", "__uri", "__sha", F.lit(b"").alias("__payload"), "__original"))

    def write(batches):
        part = TaskContext.get().partitionId()
        stream, writing, final, number, n_records, n_bytes = None, "", "", 0, 0, 0

        def done():
            stream.close()
            move(writing, final)
            columns = ([part], [final], [n_records], [n_bytes])
            types = (pa.int32(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["part", "file", "n_records", "n_bytes"])

        for batch in batches:
            for i in range(batch.num_rows):
                key, uri, sha, body, original = (batch.column(c)[i].as_py() for c in ("__id", "__uri", "__sha", "__payload", "__original"))
                if stream is None:
                    final = f"{target}/part-{part:06d}-{number:04d}.warc.gz"
                    writing = f"{final}.{uuid.uuid4().hex}.part"
                    stream, n_records, n_bytes, number = open_output(writing), 0, 0, number + 1
                member = gzip.compress(record(key, uri, body, base64.b32encode(sha).decode(), original, date), 6, mtime=0)
                stream.write(member)
                n_records, n_bytes = n_records + 1, n_bytes + len(member)
                if n_bytes >= file_bytes:
                    yield done()
                    stream = None
        if stream is not None:
            yield done()

    rows.mapInArrow(write, MANIFEST).write.parquet(f"{target}/manifest")
    drop(headers, revisits, doubtful)
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{target}/manifest")


READ = "page_id bigint, uri string, record_type string, record_id string, refers_to_id string, payload_digest string, payload_bytes bigint, payload binary"


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """A row per record of the archives: page_id (null if it had none), uri, record_type, record_id, refers_to_id, payload_digest
    (as the header has it; checked against the payload of a response), payload_bytes of the record's own block, and payload
    (null if not asked for). There are as many tasks as files."""
    files = manifest.select("file")
    files = files.repartitionByRange(max(1, files.count()), "file")

    def read(batches):
        names = ["page_id", "uri", "record_type", "record_id", "refers_to_id", "payload_digest", "payload_bytes", "payload"]
        types = [pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary()]

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for file in batch.column("file").to_pylist():
                rows, held = [], 0
                with open_input(file) as stream:
                    for h, block in parse_records(stream):
                        digest = h["warc-payload-digest"].removeprefix("sha1:")
                        if h["warc-type"] == "response" and digest != payload_digest(block):
                            raise ValueError(f"{h['warc-record-id']} in {file} doesn't have the payload of its digest")
                        key = h.get("x-record-key")
                        rows.append((int(key) if key else None, h["warc-target-uri"], h["warc-type"], h["warc-record-id"], h.get("warc-refers-to"), digest, len(block), block if payloads else None))
                        held += len(block) if payloads else 100
                        if held >= 4 << 20:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)

    return files.mapInArrow(read, READ)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to (the page_id of a revisit's response) of each
    record; a revisit takes the length of its response. Raises no error for a revisit whose response is missing: its
    payload_bytes and refers_to are then null."""
    slim = records.select("page_id", "payload_bytes", "payload_digest", "record_type", "record_id", "refers_to_id")
    responses = slim.where("record_type = 'response'").groupBy("record_id").agg(F.max("page_id").alias("__page"), F.max("payload_bytes").alias("__bytes"))
    revisit = F.coalesce(F.col("record_type") == "revisit", F.lit(False))
    # only revisits are joined: the others have no key, and would all hash to one partition
    joined = slim.where(revisit).join(responses.withColumnRenamed("record_id", "__rid"), F.col("refers_to_id") == F.col("__rid"), "left")
    found = joined.select("page_id", F.col("__bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("__page").alias("refers_to"))
    return slim.where(~revisit).select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("bigint").alias("refers_to")).unionAll(found)


def deduplicated(pages: DataFrame, **options) -> DataFrame:
    """Writes the archives to a new place in the shared folder, reads them back and resolves their revisits."""
    manifest = write_archives(pages, folder(pages.sparkSession), **options)
    return resolve_revisits(cut(read_archives(manifest, payloads=False)))
