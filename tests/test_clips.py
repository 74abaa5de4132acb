import numpy as np
import pytest
from pyspark.sql import functions as F

from wavecrest.sources.probe import probe, wav_chunks
from wavecrest.sources.wav import make_wav, parse_wav

MONO = make_wav(np.linspace(-1, 1, 33), 8000, 1, 24)
ADTS = bytes([0xFF, 0xF1, 0x50, 0x80, 0x01, 0x7F, 0xFC]) + b"\0" * 4



def page(position: int, serial: int, body: bytes) -> bytes:
    return b"OggS\0\0" + position.to_bytes(8, "little", signed=True) + serial.to_bytes(4, "little") + b"\0" * 8 + bytes([1, len(body)]) + body


VORBIS = page(0, 3, b"\x01vorbis" + b"\0" * 4 + b"\x02" + (32000).to_bytes(4, "little") + b"\0" * 14)

CASES = [
    ("a.pcm", b"\0" * 41, ("raw", 44100, 2, 10, 10 / 44100)),
    ("a.PCM", b"", ("raw", 44100, 2, 0, 0.0)),
    ("a.bin", MONO, ("wav", 8000, 1, 33, 33 / 8000)),
    ("a.wav", MONO[:-40], ("wav", 8000, 1, 20, 20 / 8000)),  # 99 bytes of samples and one of padding, 40 cut off
    ("a.wav", MONO[:30], None),
    ("a.wav", b"RIFF", None),
    ("a.wav", None, None),
    ("a.wav", b"", None),
    (None, b"fLaC", None),
    ("a.aac", ADTS * 3, ("aac", 44100, 2, 3072, 3072 / 44100)),
    ("a.aac", ADTS * 2 + ADTS[:9], ("aac", 44100, 2, 2048, 2048 / 44100)),
    ("a.ogg", b"OggS" + b"\0" * 30, None),
    ("a.ogg", VORBIS + page(500, 3, b"x") + page(900, 4, b"x") + page(-1, 3, b"x") + page(700, 3, b"x")[:20], ("vorbis", 32000, 2, 500, 500 / 32000)),
    ("a.aac", ADTS * 5000, ("aac", 44100, 2, 5000 * 1024, 5000 * 1024 / 44100)),
    ("a.pcm", None, None),
]


def test_probe(spark):
    """Whole, cut off, empty and null files; a clashing column of another meaning is replaced."""
    rows = [(i, path, content, "x") for i, (path, content, _) in enumerate(CASES)]
    got = probe(spark.createDataFrame(rows, "i int, path string, content binary, format string")).drop("path", "content").collect()
    assert len(got) == len(CASES)
    for r in got:
        want = CASES[r.i][2]
        assert tuple(r)[1:5] == (want[:4] if want else (None,) * 4), CASES[r.i][0]
        assert r.seconds == (pytest.approx(want[4]) if want else None)


@pytest.mark.parametrize("bits, is_float", [(8, False), (16, False), (24, False), (32, False), (32, True), (64, True)])
def test_chunks_are_those_of_the_reader(spark, bits, is_float):
    data = make_wav(np.linspace(-0.5, 0.5, 30), 22050, 2, bits, is_float)
    c = spark.createDataFrame([(data,)], "d binary").select(wav_chunks(F.col("d")).alias("c")).first().c
    rate, channels, pcm = parse_wav(data)
    assert (c.rate, c.channels, c.bits, c.bytes) == (rate, channels, bits, len(pcm) * bits // 8)
    assert data[c.at - 8 : c.at - 4] == b"data"


@pytest.mark.parametrize("content", [ADTS * 2, b"\xff\xfb\x90\x00" + b"\0" * 12, b"RIFF" + b"\0" * 16, b"ID3" + b"\0" * 17, b"fLaC" + b"\xff" * 40, VORBIS])
def test_what_is_named_as_headerless_is(spark, content):
    """Samples that look like a header are samples."""
    r = probe(spark.createDataFrame([("a.pcm", content)], "path string, content binary")).first()
    n = len(content) // 4
    assert tuple(r)[2:] == ("raw", 44100, 2, n, pytest.approx(n / 44100))
