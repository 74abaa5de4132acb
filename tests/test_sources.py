import numpy as np
import pytest
from pyspark.sql import functions as F

from wavecrest.functions import signal as S
from wavecrest.sources import formats, raw, wav


@pytest.mark.parametrize(("bits", "is_float"), [(8, False), (16, False), (24, False), (32, False), (32, True), (64, True), (17, False)])
def test_wav_round_trip(bits, is_float):
    x = np.clip(np.random.default_rng(1).normal(0, 0.5, 2000), -1, 1)
    sr, ch, back = wav.parse_wav(wav.make_wav(x, 44100, 2, bits, is_float))
    depth = bits if bits in (8, 16, 24, 32) and not is_float else 16
    assert (sr, ch, len(back)) == (44100, 2, 2000)
    assert np.abs(back - x).max() < (1e-6 if is_float else 1.5 / 2 ** (depth - 1) + 1e-6)


def test_wav_odd_and_broken():
    data = wav.make_wav(np.zeros(3), 8000, 1, 8)
    assert len(data) % 2 == 0 and len(wav.parse_wav(data)[2]) == 3
    assert len(wav.parse_wav(wav.make_wav(np.zeros(100), 8000, 1)[:-50])[2]) == 75
    assert wav.parse_wav(b"") is None and wav.parse_wav(b"RIFF\0\0\0\0WAVE") is None


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_headerless_files(spark, tmp_path, bits):
    x = np.round(np.clip(np.random.default_rng(bits).normal(0, 0.5, 101), -1, 1), 6)
    data = spark.createDataFrame([(x.tolist(),)], "x array<double>").select(raw.pcm_bytes(F.col("x"), bits).alias("d")).first().d
    assert len(data) == 101 * bits // 8
    (tmp_path / "a.pcm").write_bytes(data + b"\0")
    got = raw.read_pcm(spark, f"file://{tmp_path}/a.pcm", 8000, 2, bits).toPandas().sort_values(["i", "channel"])
    whole = (len(data) + 1) // (bits // 4) * 2  # samples of frames that are whole
    assert len(got) == whole and got.channel.tolist() == [0, 1] * (whole // 2) and (got.rate == 8000).all()
    assert np.abs(got.value.to_numpy()[:100] - x[:100]).max() < 1.6 / 2 ** (bits - 1) + 1e-6
    # whole files: the first 44 bytes of a WAV file are its header, the rest is the same samples
    if bits in (8, 16):
        assert wav.make_wav(x, 8000, 1, bits)[44 : 44 + len(data)] == bytes(data)


def test_laws_are_odd_and_monotone():
    for table in (wav.ulaw_table(), wav.alaw_table()):
        assert len(table) == 256 and np.allclose(np.sort(table), np.sort(-table))
        assert np.isclose(table.max(), -table.min()) and 0.95 < table.max() < 1


def test_files(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav.make_wav(np.array([0.0, 0.5, -0.5]), 8000, 1))
    (tmp_path / "b.wav").write_bytes(b"nothing")
    rows = {r.path.rpartition("/")[2]: r for r in wav.read_wav(spark, str(tmp_path)).collect()}
    assert rows["a.wav"].sr == 8000 and len(rows["a.wav"].pcm) == 3 and rows["b.wav"].pcm is None
    made = {r.path.rpartition("/")[2]: r.content for r in wav.to_wav(wav.read_wav(spark, str(tmp_path))).collect()}
    assert wav.parse_wav(bytes(made["a.wav"]))[0] == 8000 and made["b.wav"] is None


def test_formats(spark):
    heads = [b"RIFFxxxx", b"OggSxxxx", b"fLaCxxxx", b"ID3\x04\x00\x00\x00\x00\x02\x01", b"\xff\xf1\x50\x80\x02\x1f\xfc", b"\xff\xfb\x90\x64", b"\xff\xf3\x40\xc4", b"", b"text"]
    df = spark.createDataFrame([(i, bytearray(h), f"x/{i}.OGG") for i, h in enumerate(heads)], "i int, c binary, p string")
    rows = df.select("i", formats.by_magic(F.col("c")).alias("m"), formats.by_extension(F.col("p")).alias("e"), formats.mpeg_header(F.col("c")).alias("h"), formats.adts_header(F.col("c")).alias("a"), formats.tag_length(F.col("c")).alias("t")).orderBy("i").collect()
    assert [r.m for r in rows] == ["wav", "ogg", "flac", "mp3", "aac", "mp3", "mp3", None, None]
    assert {r.e for r in rows} == {"opus"}
    assert tuple(rows[5].h) == (1, 44100, 2, 128, 1152, 417) and rows[6].h.version == 2 and rows[6].h.channels == 1
    assert tuple(rows[4].a) == (44100, 2, 16) and rows[3].t == 10 + 2 * 128 + 1 and rows[0].h is None


def test_checksums(spark):
    df = spark.createDataFrame([(bytearray(b"123456789"),), (bytearray(b""),)], "c binary")
    rows = df.select(S.crc(F.col("c"), 8, 0x07).alias("a"), S.crc(F.col("c"), 16, 0x8005).alias("b"), S.crc(F.col("c"), 32, 0x04C11DB7).alias("d")).collect()
    assert tuple(rows[0]) == (0xF4, 0xFEE8, 0x89A1897F) and tuple(rows[1]) == (0, 0, 0)
