"""What a file is, by its name or its first bytes, and the fields of frame headers; all as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTENSIONS = {"wav": "wav", "wave": "wav", "mp3": "mp3", "aac": "aac", "adts": "aac", "opus": "opus", "ogg": "opus", "flac": "flac", "pcm": "raw", "raw": "raw"}


def by_extension(path: Column) -> Column:
    """The format that a file's extension stands for, whatever its case; null for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for name, kind in EXTENSIONS.items():
        out = F.when(ext == name, kind).otherwise(out)
    return out


def byte(content: Column, at: int | Column) -> Column:
    """An unsigned byte, from 0; null beyond the end."""
    place = (F.lit(at) if isinstance(at, int) else at) + 1
    one = F.hex(F.substring(content, place, F.lit(1)))
    return F.when(F.octet_length(content) >= place, F.conv(one, 16, 10).cast("int"))


def starts(content: Column, magic: bytes) -> Column:
    return F.coalesce(F.substring(content, F.lit(1), F.lit(len(magic))) == F.lit(magic), F.lit(False))


def by_magic(content: Column) -> Column:
    """The format by the first bytes, in the order RIFF, OggS, fLaC, ID3, ADTS, MPEG; null for others. An ADTS sync is 12 ones with
    layer 0, any other 11 ones are an MPEG frame."""
    b0, b1 = byte(content, 0), byte(content, 1)
    sync = (b0 == 0xFF) & (b1.bitwiseAND(F.lit(0xE0)) == 0xE0)
    adts = (b0 == 0xFF) & (b1.bitwiseAND(F.lit(0xF6)) == 0xF0)
    return (
        F.when(starts(content, b"RIFF"), "wav")
        .when(starts(content, b"OggS"), "ogg")
        .when(starts(content, b"fLaC"), "flac")
        .when(starts(content, b"ID3"), "mp3")
        .when(adts, "aac")
        .when(sync, "mp3")
    )


def tag_length(content: Column) -> Column:
    """Bytes of an ID3v2 tag at the start: 10 and four groups of 7 bits; 0 without one."""
    size = F.lit(0)
    for k in range(4):
        size = F.shiftleft(size, 7).bitwiseOR(byte(content, 6 + k).bitwiseAND(F.lit(0x7F)))
    return F.when(starts(content, b"ID3"), size + 10).otherwise(0)


def ogg_codec(page: Column) -> Column:
    """The codec that the first packet of a stream's first page names (opus, vorbis; null for others): the packet begins behind the page's table of
    segments."""
    start = 27 + byte(page, 26)
    named = lambda magic: F.substring(page, start + 1, F.lit(len(magic))) == F.lit(magic)
    known = F.when(named(b"OpusHead"), "opus").when(named(b"\x01vorbis"), "vorbis")
    return F.when(starts(page, b"OggS"), known)


def behind_tag(content: Column) -> Column:
    """The format by what the bytes hold: a stream's codec, flac, or the frame that opens behind a tag, if there is one (aac, mp3); null for others."""
    at = tag_length(content)
    b0, b1 = byte(content, at), byte(content, at + 1)
    return (
        F.when(starts(content, b"OggS"), ogg_codec(content))
        .when(starts(content, b"fLaC"), "flac")
        .when((b0 == 0xFF) & (b1.bitwiseAND(F.lit(0xF6)) == 0xF0), "aac")
        .when((b0 == 0xFF) & (b1.bitwiseAND(F.lit(0xE0)) == 0xE0), "mp3")
    )


# Fixed values of the MPEG audio layer III header, by their codes.
RATES_MPEG1 = [44100, 48000, 32000]
BITRATES_MPEG1 = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
BITRATES_MPEG2 = [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]


def mpeg_header(content: Column, at: Column | int = 0) -> Column:
    """version (1, 2 or 25), sample_rate, channels, bitrate_kbps, samples and frame_bytes of a layer III frame; null if there is none."""
    at = F.lit(at) if isinstance(at, int) else at
    b = [byte(content, at + k) for k in range(4)]
    version = F.shiftright(b[1], 3).bitwiseAND(F.lit(3))
    mpeg1 = version == 3
    rate = F.get(F.array(*map(F.lit, RATES_MPEG1)), F.shiftright(b[2], 2).bitwiseAND(F.lit(3)))
    rate = F.when(mpeg1, rate).when(version == 2, (rate / 2).cast("int")).otherwise((rate / 4).cast("int"))
    code = F.shiftright(b[2], 4)
    kbps = F.when(mpeg1, F.get(F.array(*map(F.lit, BITRATES_MPEG1)), code)).otherwise(F.get(F.array(*map(F.lit, BITRATES_MPEG2)), code))
    samples = F.when(mpeg1, 1152).otherwise(576)
    size = F.floor(F.when(mpeg1, 144000).otherwise(72000) * kbps / rate) + F.shiftright(b[2], 1).bitwiseAND(F.lit(1))
    good = (b[0] == 0xFF) & (b[1].bitwiseAND(F.lit(0xE6)) == 0xE2) & (version != 1) & (kbps > 0) & rate.isNotNull()
    fields = F.struct(
        F.when(mpeg1, 1).when(version == 2, 2).otherwise(25).alias("version"),
        rate.alias("sample_rate"),
        F.when(F.shiftright(b[3], 6) == 3, 1).otherwise(2).alias("channels"),
        kbps.alias("bitrate_kbps"),
        samples.alias("samples"),
        size.alias("frame_bytes"),
    )
    return F.when(good, fields)


# Sampling rates and channels of ADTS headers, by their codes, and the profile that is read.
RATES_ADTS = [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000]
CHANNELS_ADTS = [0, 1, 2, 3, 4, 5, 6, 8]
LOW_COMPLEXITY = 1


def adts_header(content: Column, at: Column | int = 0) -> Column:
    """sample_rate, channels and frame_bytes of an ADTS frame; null if there is none, or one of another profile than low complexity."""
    at = F.lit(at) if isinstance(at, int) else at
    b = [byte(content, at + k) for k in range(7)]
    rate = F.get(F.array(*map(F.lit, RATES_ADTS)), F.shiftright(b[2], 2).bitwiseAND(F.lit(15)))
    channels = F.shiftleft(b[2].bitwiseAND(F.lit(1)), 2).bitwiseOR(F.shiftright(b[3], 6))
    channels = F.get(F.array(*map(F.lit, CHANNELS_ADTS)), channels)
    size = F.shiftleft(b[3].bitwiseAND(F.lit(3)), 11).bitwiseOR(F.shiftleft(b[4], 3)).bitwiseOR(F.shiftright(b[5], 5))
    good = (b[0] == 0xFF) & (b[1].bitwiseAND(F.lit(0xF6)) == 0xF0) & (F.shiftright(b[2], 6) == LOW_COMPLEXITY) & rate.isNotNull() & (size >= 7)
    return F.when(good, F.struct(rate.alias("sample_rate"), channels.alias("channels"), size.alias("frame_bytes")))
