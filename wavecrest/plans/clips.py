"""Clips as files of bytes, and what they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrest.operators.bridge import frames
from wavecrest.sources.bits import le_hex
from wavecrest.sources.probe import probe
from wavecrest.sources.raw import pcm_bytes

ORACLES: dict[str, str] = {}
KINDS = ("wav", "aac", "mp3", "flac", "opus", "pcm", "txt")
HEAD = 100  # bytes of samples that a made frame or page holds


def text_hex(text: str) -> Column:
    return F.lit(text.encode().hex().upper())


def big_hex(value: Column, n: int) -> Column:
    return F.lpad(F.hex(value.cast("bigint")), 2 * n, "0")


def wav_file(body: Column, rate: Column, channels: int, extra: str = "") -> Column:
    """A WAV file, in hexadecimal, of 16-bit samples given so; ``extra`` is a chunk's body, before the samples."""
    size = F.length(body) / 2  # in bytes; sizes are counted, so that the samples occur once in the expression
    form = F.concat(le_hex(F.lit(1), 2), le_hex(F.lit(channels), 2), le_hex(rate, 4), le_hex(rate * 2 * channels, 4), le_hex(F.lit(2 * channels), 2), le_hex(F.lit(16), 2))
    padded = extra + "\0" * (len(extra) % 2)
    more = F.concat(text_hex("LIST"), le_hex(F.lit(len(extra)), 4), text_hex(padded)) if extra else F.lit("")
    before = 4 + 24 + 8 + (8 + len(padded) if extra else 0)
    return F.concat(text_hex("RIFF"), le_hex(size + before, 4), text_hex("WAVEfmt "), le_hex(F.lit(16), 4), form, more, text_hex("data"), le_hex(size, 4), body)


def clip_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_no, path, content: each frame as a file, of one kind by its number. Coded files hold 1 to 7 frames and a broken one behind them."""
    f = frames(spark, sf_dir).where("frame_no is not null and x is not null").select("frame_no", F.hex(pcm_bytes(F.col("x"), 16)).alias("pcm"))
    f = f.withColumns({"m": F.pmod("frame_no", F.lit(7)).cast("int") + 1, "some": F.rpad(F.substring("pcm", 1, 2 * HEAD), 2 * HEAD, "0")})
    pcm, some, m = F.col("pcm"), F.col("some"), F.col("m")
    wav = wav_file(pcm, 8000 + 100 * m, 2, "odd")
    length = 7 + HEAD
    aac = F.concat(F.lit(f"FFF1{0x40 | 4 << 2:02X}{2 << 6 | length >> 11:02X}{length >> 3 & 255:02X}{(length & 7) << 5 | 31:02X}FC"), some)
    aac = F.concat(F.repeat(aac, m), F.substring(aac, 1, 2 * HEAD))
    mp3 = F.concat(F.lit("FFFB9000"), F.rpad(some, 2 * 413, "0"))  # 128 kbit/s at 44100 Hz: 417 bytes
    tag = F.concat(text_hex("ID3"), F.lit("030000"), F.lit("0000"), F.lit(f"{HEAD >> 7:02X}{HEAD & 127:02X}"), some)
    mp3 = F.concat(tag, F.repeat(mp3, m), F.substring(mp3, 1, 100))
    info = F.shiftleft(F.lit(44100).cast("bigint"), 44).bitwiseOR(F.lit(1 << 41 | 15 << 36)).bitwiseOR((m * 4096 + F.floor(F.length(pcm) / 8)).cast("bigint"))
    flac = F.concat(text_hex("fLaC"), F.lit("00000022"), F.lit("1000" * 2 + "00" * 6), big_hex(info, 8), F.lit("00" * 16), some)
    page = lambda position, serial, body: F.concat(text_hex("OggS"), F.lit("0000"), le_hex(position, 8), le_hex(serial, 4), F.lit("00" * 8 + "01"), le_hex(F.length(body) / 2, 1), body)
    head = F.concat(text_hex("OpusHead"), F.lit("0102"), le_hex(F.lit(312), 2), F.lit("80BB0000000000"))
    inner = F.transform(F.sequence(F.lit(1), m), lambda k: F.concat(page(k.cast("bigint") * 960, F.lit(5), some), page(F.lit(77), F.lit(6), some)))
    opus = F.concat(page(F.lit(0), F.lit(5), head), F.array_join(inner, ""), page(F.lit(-1), F.lit(5), some), F.substring(page(F.lit(9), F.lit(5), some), 1, 80))
    made = F.lit("")
    kind = F.pmod("frame_no", F.lit(len(KINDS)))
    for k, body in enumerate((wav, aac, mp3, flac, opus, pcm, F.concat(text_hex("no clip "), some))):
        made = F.when(kind == k, body).otherwise(made)
    ext = F.get(F.array(*map(F.lit, KINDS)), kind.cast("int"))
    return f.select("frame_no", F.format_string("clips/%d.%s", "frame_no", ext).alias("path"), F.unhex(made).alias("content"))


def clip_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame as a file of some format, told from its bytes: format, rate, channels, samples of a channel, seconds; null for a file that is none."""
    c = probe(clip_files(spark, sf_dir), raw=(48000, 2, 16))
    return c.select("path", "format", "rate", "channels", "frames", F.round("seconds", 6).alias("seconds"))


ORACLES["clip_info"] = """WITH c AS (SELECT vec_id, vec_id % 7 AS k, vec_id % 7 + 1 AS m, len(embedding) AS n FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT concat('clips/', vec_id, '.', ['wav', 'aac', 'mp3', 'flac', 'opus', 'pcm', 'txt'][k + 1]) AS path, ['wav', 'aac', 'mp3', 'flac', 'opus', 'raw', NULL][k + 1] AS format,
CAST(CASE k WHEN 0 THEN 8000 + 100 * m WHEN 4 THEN 48000 WHEN 5 THEN 48000 WHEN 6 THEN NULL ELSE 44100 END AS BIGINT) AS rate, CAST(CASE WHEN k < 6 THEN 2 END AS BIGINT) AS channels,
CAST(CASE k WHEN 0 THEN n // 2 WHEN 1 THEN 1024 * m WHEN 2 THEN 1152 * m WHEN 3 THEN 4096 * m + n // 2 WHEN 4 THEN 960 * m - 312 WHEN 5 THEN n // 2 END AS BIGINT) AS frames FROM c)
SELECT *, round(frames / rate, 6) AS seconds FROM p"""


QUERIES = {f.__name__: f for f in (clip_info,)}
