"""What a clip is without decoding it: format, rate, channels and frames of a file held as bytes, all as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavecrest.functions import signal as S
from wavecrest.sources.bits import byte_values
from wavecrest.sources.formats import adts_header, behind_tag, by_extension, byte, mpeg_header, starts, tag_length

# Kinds of WAV samples and their depths, samples of an ADTS frame, the rate of an Opus stream's positions.
WAV_DEPTHS = {1: (8, 16, 24, 32), 3: (32, 64), 6: (8,), 7: (8,)}
WAV_EXTENSIBLE, ADTS_SAMPLES, OPUS_RATE = 0xFFFE, 1024, 48000


def i64(v) -> Column:
    return (F.lit(v) if isinstance(v, int) else v).cast("bigint")


def number(content: Column, at: Column | int, n: int, big: bool = False) -> Column:
    """``n`` bytes from ``at`` on as a number, the lowest first or the highest (``big``); null beyond the end."""
    at = (F.lit(at) if isinstance(at, int) else at).cast("int")
    out = i64(0)
    for k in range(n):
        out = out.bitwiseOR(F.shiftleft(i64(byte(content, at + k)), 8 * (n - 1 - k if big else k)))
    return out


def walk(content: Column, start: Column, step) -> Column:
    """``start``, a struct, stepped until its field ``done`` is true; every step takes a byte or ends the walk. Steps come in blocks of about the root of the
    content's length, so that no list as long as the content is made."""
    block = F.sequence(F.lit(1), F.ceil(F.sqrt(F.octet_length(content) + 1)).cast("int"))
    once = lambda a, _: F.when(a["done"], a).otherwise(step(a))
    return F.reduce(block, start, lambda a, _: F.when(a["done"], a).otherwise(F.reduce(block, a, once)))


def wav_chunks(content: Column) -> Column:
    """rate, channels, kind, bits, at and bytes of a WAV file's samples, as far as they go; null without a form and samples in it, or of a depth that doesn't
    exist. Chunks are aligned to words."""
    n, none = i64(F.octet_length(content)), F.lit(None).cast("bigint")

    def step(a: Column) -> Column:
        at = a["at"]
        name, size = F.substring(content, (at + 1).cast("int"), F.lit(4)), number(content, at + 4, 4)
        form = (name == F.lit(b"fmt ")) & (size >= 16) & (at + 24 <= n)
        data = (name == F.lit(b"data")) & a["rate"].isNotNull()
        kind = number(content, at + 8, 2)
        kind = F.when((kind == WAV_EXTENSIBLE) & (size >= 26), number(content, at + 32, 2)).otherwise(kind)
        read = lambda field, value: F.when(form, value).otherwise(a[field]).alias(field)
        following = at + 8 + size + F.pmod(size, F.lit(2))
        return F.struct(
            F.when(data, at + 8).otherwise(F.coalesce(following, n)).alias("at"),
            read("kind", kind), read("channels", number(content, at + 10, 2)), read("rate", number(content, at + 12, 4)), read("bits", number(content, at + 22, 2)),
            F.when(data, F.least(size, n - at - 8)).alias("bytes"),
            F.coalesce(data | (following + 8 > n), F.lit(True)).alias("done"),
        )

    opened = starts(content, b"RIFF") & (F.substring(content, F.lit(9), F.lit(4)) == F.lit(b"WAVE"))
    start = F.struct(i64(12).alias("at"), *(none.alias(x) for x in ("kind", "channels", "rate", "bits", "bytes")), (n < 20).alias("done"))
    legal = lambda f: (f["channels"] > 0) & f["bytes"].isNotNull() & F.concat_ws(":", f["kind"], f["bits"]).isin([f"{k}:{b}" for k, depths in WAV_DEPTHS.items() for b in depths])
    return F.when(opened, S.let(walk(content, start, step), lambda f: F.when(legal(f), f)))


def frames_of(content: Column, first: Column, header, samples) -> Column:
    """Samples of the frames that follow each other from ``first`` on, up to the first place where none opens or one breaks off."""
    n = i64(F.octet_length(content))

    def step(a: Column) -> Column:
        def taken(h: Column) -> Column:
            end = a["at"] + h["frame_bytes"]
            whole = F.coalesce(end <= n, F.lit(False))
            return F.struct(F.when(whole, end).otherwise(a["at"]).alias("at"), (a["samples"] + F.when(whole, samples(h)).otherwise(0)).cast("bigint").alias("samples"), (~whole | (end >= n)).alias("done"))

        return S.let(header(content, a["at"].cast("int")), taken)

    return walk(content, F.struct(i64(first).alias("at"), i64(0).alias("samples"), F.lit(False).alias("done")), step)["samples"]


def last_position(content: Column) -> Column:
    """The position that the last whole page of the first stream gives; pages without one (all ones) and those of other streams are passed over."""
    n, serial = i64(F.octet_length(content)), number(content, 14, 4)

    def step(a: Column) -> Column:
        at = a["at"]
        table = byte_values(F.substring(content, (at + 28).cast("int"), byte(content, (at + 26).cast("int"))))
        end = at + 27 + F.size(table) + S.total(table).cast("bigint")
        page = F.substring(content, (at + 1).cast("int"), F.lit(4)) == F.lit(b"OggS")
        whole = F.coalesce(page & (byte(content, (at + 26).cast("int")) == F.size(table)) & (end <= n), F.lit(False))
        position = number(content, at + 6, 8)
        mine = whole & (position != -1) & (number(content, at + 14, 4) == serial)
        return F.struct(F.when(whole, end).otherwise(at).alias("at"), F.when(mine, position).otherwise(a["position"]).alias("position"), (~whole | (end >= n)).alias("done"))

    return walk(content, F.struct(i64(0).alias("at"), F.lit(None).cast("bigint").alias("position"), F.lit(False).alias("done")), step)["position"]


def probe(files: DataFrame, raw: tuple[int, int, int] = (44100, 2, 16), path: str = "path", content: str = "content") -> DataFrame:
    """files with format, rate, channels, frames (samples of a channel) and seconds; null for one that is none of the formats or breaks off before they can be
    told. What is named as headerless counts as such, of rate, channels and bits ``raw``, since its samples may look like a header; any other name is passed over
    for what the bytes tell. Coded frames count with all their samples; positions of an Opus stream less what precedes its start. Columns of these names are replaced."""
    kept = [c for c in files.columns if c not in ("format", "rate", "channels", "frames", "seconds")]
    d, c, kind = files.select(*kept), F.col(content), F.col("__kind")
    d = d.withColumns({"__kind": F.when(by_extension(F.col(path)) == "raw", "raw").when(starts(c, b"RIFF"), "wav").otherwise(behind_tag(c)), "__first": tag_length(c), "__head": 27 + byte(c, 26)})
    at, head = F.col("__first"), F.col("__head")  # of an Ogg file the first packet
    d = d.withColumns({
        "__wav": F.when(kind == "wav", wav_chunks(c)),
        "__aac": F.when(kind == "aac", adts_header(c, at)),
        "__mp3": F.when(kind == "mp3", mpeg_header(c, at)),
        "__info": F.when(kind == "flac", number(c, 18, 8, big=True)),
        "__last": F.when(kind.isin("opus", "vorbis"), last_position(c)),
    })
    coded = {"aac": (F.col("__aac").isNotNull(), adts_header, lambda _: F.lit(ADTS_SAMPLES)), "mp3": (F.col("__mp3").isNotNull(), mpeg_header, lambda h: h["samples"])}
    d = d.withColumns({f"__{k}_frames": F.when(there, frames_of(c, at, header, samples)) for k, (there, header, samples) in coded.items()})
    info, (rate, channels, bits) = F.col("__info"), raw
    fields = {
        "wav": ("__wav.rate", "__wav.channels", F.floor(F.col("__wav.bytes") / (F.col("__wav.channels") * F.floor(F.col("__wav.bits") / 8)))),
        "aac": ("__aac.sample_rate", "__aac.channels", F.col("__aac_frames")),
        "mp3": ("__mp3.sample_rate", "__mp3.channels", F.col("__mp3_frames")),
        "flac": (F.shiftright(info, 44).bitwiseAND(F.lit((1 << 20) - 1)), F.shiftright(info, 41).bitwiseAND(F.lit(7)) + 1, info.bitwiseAND(F.lit((1 << 36) - 1))),
        "opus": (F.lit(OPUS_RATE), byte(c, head + 9), F.greatest(F.col("__last") - number(c, head + 10, 2), F.when(F.col("__last").isNotNull(), i64(0)))),
        "vorbis": (number(c, head + 12, 4), byte(c, head + 11), F.col("__last")),
        "raw": (F.lit(rate), F.lit(channels), F.floor(F.octet_length(c) / (channels * bits // 8))),
    }
    found = {}
    for k, name in enumerate(("rate", "channels", "frames")):
        value = F.lit(None).cast("bigint")
        for form, columns in fields.items():
            one = F.col(columns[k]) if isinstance(columns[k], str) else columns[k]
            value = F.when(kind == form, one.cast("bigint")).otherwise(value)
        found[f"__{name}"] = value
    known = F.col("__rate").isNotNull() & F.col("__channels").isNotNull() & F.col("__frames").isNotNull()
    out = {"format": kind, "rate": F.col("__rate"), "channels": F.col("__channels"), "frames": F.col("__frames"), "seconds": F.when(F.col("__rate") > 0, F.col("__frames") / F.col("__rate"))}
    return d.withColumns(found).select(*kept, *(F.when(known, v).alias(n) for n, v in out.items()))
