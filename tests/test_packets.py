"""Packet framing against a plain parser on random, valid and broken packets; headers and bit fields on known bytes."""

import random

from pyspark.sql import functions as F

from wavecrest.plans import packets
from wavecrest.sources import bits, formats


class Refused(Exception):
    pass


def plain(data, delimited):
    """config, samples, [(offset, size)], taken; raises Refused."""
    pos = 0

    def length():
        nonlocal pos
        if pos >= end:
            raise Refused
        one = data[pos]
        pos += 1
        if one < 252:
            return one
        if pos >= end:
            raise Refused
        pos += 1
        return 4 * data[pos - 1] + one

    if not data:
        raise Refused
    toc, end = data[0], len(data)
    pos, config, code = 1, toc >> 3, toc & 3
    samples = [480, 960, 1920, 2880][config & 3] if config < 12 else 480 << (config & 1) if config < 16 else 120 << (config & 3)
    count, pad, sizes, vbr = {0: 1, 1: 2, 2: 2}.get(code), 0, [], code == 2
    if code == 1 and not delimited and (end - 1) % 2:
        raise Refused
    if code == 3:
        if end < 2:
            raise Refused
        head = data[1]
        pos, count, vbr = 2, head & 63, head >= 128
        if not 0 < count <= 48 or samples * count > 5760:
            raise Refused
        if head & 64:
            while True:
                if pos >= end:
                    raise Refused
                pos += 1
                pad += min(data[pos - 1], 254)
                if data[pos - 1] != 255:
                    break
        end -= pad
        if pos > end:
            raise Refused
    if vbr:
        for _ in range(count - 1):
            sizes.append(length())
            if sum(sizes) > end - pos:
                raise Refused
    if delimited:
        last = length()
        sizes = [*sizes, last] if vbr else [last] * count
        if sum(sizes) > end - pos:
            raise Refused
    elif vbr:
        sizes.append(end - pos - sum(sizes))
    else:
        if (end - pos) % count:
            raise Refused
        sizes = [(end - pos) // count] * count
    if max(sizes) > 1275:
        raise Refused
    places = [pos + sum(sizes[:k]) for k in range(count)]
    return config, samples, list(zip(places, sizes, strict=True)), pad + pos + sum(sizes)


def some_packets():
    r = random.Random(7)
    out = [b"", b"\xff", b"\x03", b"\x03\x00", b"\x03\x31", b"\xf3\x41\xff", b"\xf3\x41\xff\x05" + bytes(300), b"\x00" + bytes(1276), b"\x02\xfc", b"\x02\xfd\x01" + bytes(300)]
    for _ in range(1500):
        code, config = r.randrange(4), r.choice([0, 1, 12, 16, 20, 24, 28, r.randrange(32)])
        toc = config << 3 | r.randrange(2) << 2 | code
        body = bytes(r.choice([0, 1, 5, 20, 251, 252, 255, r.randrange(256)]) for _ in range(r.choice([0, 1, 2, 3, 9, 40, 300, 1400])))
        if code == 3 and r.random() < 0.8:
            body = bytes([r.randrange(1, 6) | r.choice([0, 64, 128, 192])]) + body
        out.append(bytes([toc]) + body)
    return out


def test_inner_frames(spark):
    rows = [(k, d, list(p)) for k, p in enumerate(some_packets()) for d in (False, True)]
    got = packets.inner_frames(spark.createDataFrame(rows, "id int, delimited boolean, b array<bigint>")).collect()
    assert len(got) == len(rows)
    by = {(r.id, r.delimited): r for r in got}
    valid = 0
    for k, d, data in rows:
        r = by[k, d]
        try:
            config, samples, frames, taken = plain(bytes(data), d)
        except Refused:
            assert r.refused is not None and r.frames is None, (data[:8], d)
        else:
            valid += 1
            assert (r.refused, r.config, r.samples, [(f.offset, f.size) for f in r.frames], r.taken) == (None, config, samples, frames, taken), (data[:8], d)
    assert valid > 300 and {r.refused for r in got} >= {None, "empty", "odd", "count", "padding", "size", "last", "uneven", "large"}


def test_low_bits(spark):
    data = bytes(random.Random(3).randrange(256) for _ in range(20))
    n = int.from_bytes(data, "little")
    wants = [(at, w) for at in range(0, 150, 7) for w in (1, 4, 13, 32)]
    row = spark.createDataFrame([(data,)], "d binary").select(bits.byte_values(F.col("d")).alias("b")).select(*[bits.low_bits(F.col("b"), at, w).alias(f"{at}_{w}") for at, w in wants]).first()
    for at, w in wants:
        assert row[f"{at}_{w}"] == (n >> at & (1 << w) - 1 if at + w <= 160 else None)


def test_broken_comment_headers(spark):
    good = b"\x03vorbis\x02\0\0\0ab\x01\0\0\0\x03\0\0\0a=b\x01"
    cases = [(good, None), (good[:-1], "short"), (good[:-1] + b"\x00", "framing"), (b"\x01" + good[1:], "magic"), (b"", "magic"), (good[:9], "short"), (good[:17] + b"\xff\xff\xff\x7f" + good[21:], "short"), (b"\x03vorbis\0\0\0\0\0\0\0\0\x01", None)]
    got = packets.comments(spark.createDataFrame([(k, d) for k, (d, _) in enumerate(cases)], "id int, data binary")).orderBy("id").collect()
    assert [r.refused for r in got] == [why for _, why in cases]
    assert got[0].comments == ["a=b"] and got[0].vendor == "ab" and got[7].comments == []


def test_frame_headers_of_other_profiles(spark):
    header = lambda profile, code, length: bytes([0xFF, 0xF1, profile << 6 | 4 << 2 | code >> 2, (code & 3) << 6 | length >> 11, length >> 3 & 255, (length & 7) << 5, 0xFC])
    cases = [header(1, 7, 100), header(1, 2, 7), header(0, 2, 100), header(2, 2, 100), header(1, 2, 6), header(1, 0, 9)]
    got = [r.f for r in spark.createDataFrame([(k, h) for k, h in enumerate(cases)], "id int, d binary").orderBy("id").select(formats.adts_header(F.col("d")).alias("f")).collect()]
    assert [None if f is None else (f.sample_rate, f.channels, f.frame_bytes) for f in got] == [(44100, 8, 100), (44100, 2, 7), None, None, None, (44100, 0, 9)]
