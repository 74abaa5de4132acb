"""What containers and decoders do around the samples: edit lists, channel maps, streams of one kind, header fields, checksums, raw samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavecrest.functions import signal as S
from wavecrest.operators.bridge import CHANNELS_SQL, FRAMES_SQL, PAIRS_SQL, channels, frames, pairs, table
from wavecrest.plans.sequence import PCM_SQL
from wavecrest.sources.raw import pcm_bytes, pcm_values

ORACLES: dict[str, str] = {}
PRE_SKIP, GAIN_Q8 = 3, -1536


def edit_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels as a player gives them: a gain in 256ths of a decibel, the first samples dropped (where there are as many), and what lies beyond the
    total that the last position states, here two samples from the end."""
    w = Window.partitionBy("channel")
    c = channels(spark, sf_dir).withColumn("n", F.count("*").over(w))
    skip = F.when(F.col("n") >= PRE_SKIP, PRE_SKIP).otherwise(0)
    place = F.col("i") - skip
    gain = 10 ** (GAIN_Q8 / (20 * 256))
    out = c.where((place >= 0) & (place < F.greatest(F.col("n") - 5, F.lit(0))))
    return out.select("channel", place.cast("bigint").alias("place"), F.round(F.col("x") * gain, 6).alias("x"))


ORACLES["edit_list"] = f"""WITH {CHANNELS_SQL}, n AS (SELECT channel, count(*) AS n FROM c GROUP BY 1), p AS (SELECT channel, n, x, i - CASE WHEN n >= 3 THEN 3 ELSE 0 END AS place FROM c JOIN n USING (channel))
SELECT channel, place, round(x * pow(10, -1536 / 5120.0), 6) AS x FROM p WHERE place >= 0 AND place < greatest(n - 5, 0)"""


def last_block(spark: SparkSession, sf_dir: str, size: int = 10) -> DataFrame:
    """Blocks of ``size`` samples of a channel; the last one is filled up with zeros."""
    b = channels(spark, sf_dir).groupBy("channel", F.floor(F.col("i") / size).alias("block"))
    b = b.agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s"))  # ``size`` samples at most
    whole = F.concat(F.transform("s", lambda s: s["x"]), F.array_repeat(S.lit(0), F.lit(size) - F.size("s")))
    out = b.select("channel", "block", F.size("s").cast("bigint").alias("n"), F.posexplode(whole).alias("k", "x"))
    return out.select("channel", "block", "n", F.col("k").cast("bigint").alias("k"), "x")


ORACLES["last_block"] = f"""WITH {CHANNELS_SQL}, b AS (SELECT channel, i // 10 AS block, count(*) AS n FROM c GROUP BY 1, 2)
SELECT b.channel, block, n, k, coalesce(x, 0.0) AS x FROM b CROSS JOIN range(0, 10) t(k) LEFT JOIN c ON c.channel = b.channel AND c.i = block * 10 + k"""


def channel_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output channels of a pair by a map of stream channels, in which 255 is silence: right, left, silence, right."""
    mapping = F.array(*map(F.lit, (1, 0, 255, 1)))
    out = F.transform(mapping, lambda m: F.when(m == 0, F.col("l")).when(m == 1, F.col("r")))
    p = pairs(spark, sf_dir).select("frame_no", F.size("l").alias("n"), F.posexplode(out).alias("output", "x"))
    silent = F.transform(F.sequence(F.lit(1), "n"), lambda _: S.lit(0))
    p = p.where("n > 0").select("frame_no", F.col("output").cast("bigint").alias("output"), F.posexplode(F.coalesce("x", silent)).alias("i", "x"))
    return p.select("frame_no", "output", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x"))


ORACLES["channel_map"] = f"""WITH {PAIRS_SQL}, m AS (SELECT * FROM (VALUES (0, 1), (1, 0), (2, 255), (3, 1)) t(output, source))
SELECT frame_no, CAST(output AS BIGINT) AS output, i, round(CASE source WHEN 0 THEN l WHEN 1 THEN r ELSE 0 END, 6) AS x FROM p, m"""


def first_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a user's events only those of the type that opens: the first by time is its stream's serial, and others are left out. The serial is a partially
    aggregated minimum, joined back."""
    e = table(spark, sf_dir, "events").where("event_type is not null")
    first = e.groupBy(F.col("user_id").alias("u")).agg(F.min(F.struct("ts", "event_id", "event_type")).alias("f"))
    kept = e.join(first, (F.col("user_id") == F.col("u")) & (F.col("event_type") == F.col("f.event_type")), "left_semi")
    return kept.groupBy("user_id", "event_type").agg(F.count("*").alias("pages"), F.round(F.sum("value"), 4).alias("total"))


ORACLES["first_stream"] = """WITH f AS (SELECT user_id, event_type AS serial FROM events WHERE event_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1)
SELECT user_id, event_type, count(*) AS pages, round(sum(value), 4) AS total FROM events JOIN f USING (user_id) WHERE event_type = serial GROUP BY 1, 2"""


def leading_samples(spark: SparkSession, sf_dir: str, most: int = 20) -> DataFrame:
    """The first samples of each channel alone; a truncation that comparisons of long clips ask for."""
    c = channels(spark, sf_dir).where(F.col("i") < most)
    return c.groupBy("channel").agg(F.count("*").alias("n"), F.round(F.sum(F.col("x") * F.col("x")), 4).alias("energy"))


ORACLES["leading_samples"] = f"WITH {CHANNELS_SQL} SELECT channel, count(*) AS n, round(sum(x * x), 4) AS energy FROM c WHERE i < 20 GROUP BY 1"


def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames and bytes of each conversation as a stream, a frame per turn."""
    n = F.coalesce(F.octet_length("text"), F.lit(0))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("frames"), F.sum(n).alias("bytes"), F.max(n).cast("bigint").alias("largest"))


ORACLES["stream_totals"] = "SELECT conv_id, count(*) AS frames, CAST(sum(coalesce(octet_length(encode(text)), 0)) AS BIGINT) AS bytes, CAST(max(coalesce(octet_length(encode(text)), 0)) AS BIGINT) AS largest FROM conversations GROUP BY 1"


def raw_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as headerless 16-bit samples, lowest byte first, and read back from these bytes; the bytes' number and the samples over 32768."""
    b = frames(spark, sf_dir).where(F.size("x") > 0).select("frame_no", pcm_bytes(F.col("x"), 16).alias("data"))
    out = b.select("frame_no", F.octet_length("data").cast("bigint").alias("bytes"), F.posexplode(pcm_values(F.col("data"), 16)).alias("i", "v"))
    return out.select("frame_no", "bytes", F.col("i").cast("bigint").alias("i"), (F.col("v") / 32768).alias("x"))


ORACLES["raw_samples"] = f"WITH {PCM_SQL}, n AS (SELECT frame_no, 2 * count(*) AS bytes FROM f GROUP BY 1) SELECT frame_no, bytes, i, v / 32768.0 AS x FROM q JOIN n USING (frame_no)"


def text_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of the turns of conversations in UTF-8, highest bit first, from 0: 8 bits (polynomial 0x07), 16 bits (0x8005) and 32 bits (0x04C11DB7)."""
    data = F.col("text").cast("binary")
    c = table(spark, sf_dir, "conversations").where("text is not null")
    return c.select("conv_id", "turn", S.crc(data, 8, 0x07).alias("crc8"), S.crc(data, 16, 0x8005).alias("crc16"), S.crc(data, 32, 0x04C11DB7).alias("crc32"))


def _crc_sql(width: int, poly: int) -> str:
    mask, top = (1 << width) - 1, 1 << (width - 1)
    bit = f"CASE WHEN r & {top} <> 0 THEN xor((r << 1) & {mask}, {poly}) ELSE (r << 1) & {mask} END"
    return f"""list_reduce(list_prepend(CAST(0 AS BIGINT), b), lambda acc, y: list_reduce(list_prepend(xor(acc, (y << {width - 8}) & {mask}), range(0, 8)), lambda r, k: {bit}))"""


ORACLES["text_checksums"] = f"""WITH c AS (SELECT conv_id, turn, hex(encode(text)) AS h FROM conversations WHERE text IS NOT NULL), b AS (SELECT conv_id, turn, list_transform(range(0, length(h) // 2), lambda k: CAST(('0x' || substr(h, 2 * k + 1, 2)) AS BIGINT)) AS b FROM c)
SELECT conv_id, turn, {_crc_sql(8, 0x07)} AS crc8, {_crc_sql(16, 0x8005)} AS crc16, {_crc_sql(32, 0x04C11DB7)} AS crc32 FROM b"""


def byte_at(data: Column, k: int) -> Column:
    """Byte k, from 0, of a binary column as a number; null beyond its end."""
    return F.conv(F.hex(F.nullif(F.substring(data, F.lit(k + 1), F.lit(1)), F.lit(b""))), 16, 10).cast("bigint")


def big_endian(data: Column, first: int, n: int) -> Column:
    out = byte_at(data, first)
    for k in range(first + 1, first + n):
        out = F.shiftleft(out, 8).bitwiseOR(byte_at(data, k))
    return out


def stream_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of the 34-byte block that opens a lossless stream, from the first bytes of each document, and whether they are legal."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.substring(F.col("text").cast("binary"), F.lit(1), F.lit(34)).alias("d")).where("octet_length(d) = 34")
    x, d = big_endian(F.col("d"), 10, 8), d.withColumns({"least": big_endian(F.col("d"), 0, 2), "most": big_endian(F.col("d"), 2, 2)})
    bits = lambda shift, width: F.shiftright(F.col("x"), shift).bitwiseAND(F.lit((1 << width) - 1))
    out = d.withColumn("x", x).select("doc_id", F.col("least").alias("min_block"), F.col("most").alias("max_block"), bits(44, 20).alias("rate"), (bits(41, 3) + 1).alias("channels"), (bits(36, 5) + 1).alias("bits"), bits(0, 36).alias("samples"))
    legal = (F.col("min_block") > 0) & (F.col("max_block") >= F.col("min_block")) & (F.col("rate") > 0) & (F.col("channels") <= 8) & F.col("bits").between(4, 32)
    return out.withColumn("legal", legal)


ORACLES["stream_info"] = """WITH d AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE octet_length(encode(text)) >= 34), x AS (SELECT doc_id, CAST('0x' || substr(h, 1, 4) AS BIGINT) AS a, CAST('0x' || substr(h, 5, 4) AS BIGINT) AS b, CAST('0x' || substr(h, 21, 8) AS BIGINT) AS hi, CAST('0x' || substr(h, 29, 8) AS BIGINT) AS lo FROM d),
f AS (SELECT doc_id, a AS min_block, b AS max_block, hi >> 12 AS rate, ((hi >> 9) & 7) + 1 AS channels, ((hi >> 4) & 31) + 1 AS bits, (hi & 15) * 4294967296 + lo AS samples FROM x)
SELECT *, min_block > 0 AND max_block >= min_block AND rate > 0 AND channels <= 8 AND bits BETWEEN 4 AND 32 AS legal FROM f"""


def packet_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as packets: the fields of the byte that opens one (configuration, whether it is stereo, code of its frames), and the length that
    follows in one byte, or two from 252 on."""
    t = table(spark, sf_dir, "conversations").where("octet_length(text) > 0").select("conv_id", "turn", F.col("text").cast("binary").alias("d"))
    toc, one, two = (byte_at(F.col("d"), k) for k in range(3))
    size = F.when(one < 252, one).otherwise(4 * two + one)
    return t.select("conv_id", "turn", F.shiftright(toc, 3).alias("config"), (toc.bitwiseAND(F.lit(4)) != 0).alias("stereo"), toc.bitwiseAND(F.lit(3)).alias("code"), size.alias("size"))


ORACLES["packet_heads"] = """WITH h AS (SELECT conv_id, turn, hex(encode(text)) AS h FROM conversations WHERE octet_length(encode(text)) > 0), b AS (SELECT conv_id, turn, CAST('0x' || substr(h, 1, 2) AS BIGINT) AS toc, CAST(CASE WHEN length(h) >= 4 THEN '0x' || substr(h, 3, 2) END AS BIGINT) AS one, CAST(CASE WHEN length(h) >= 6 THEN '0x' || substr(h, 5, 2) END AS BIGINT) AS two FROM h)
SELECT conv_id, turn, toc >> 3 AS config, toc & 4 <> 0 AS stereo, toc & 3 AS code, CASE WHEN one < 252 THEN one ELSE 4 * two + one END AS size FROM b"""


def float_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event numbers spread over 32 bits, read as packed floats (sign, 10 bits of exponent over 788, 21 of mantissa); and the greatest r with r to the third
    power at most the number of a thousand of them."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 2654435761).bitwiseAND(F.lit((1 << 32) - 1)).alias("v"))
    mantissa, exponent = F.col("v").bitwiseAND(F.lit(0x1FFFFF)), F.shiftright("v", 21).bitwiseAND(F.lit(0x3FF)) - 788
    value = F.when(F.shiftright("v", 31) == 1, -mantissa).otherwise(mantissa) * F.pow(S.lit(2), exponent)
    n = F.shiftright("v", 12)
    root = F.floor(F.cbrt(n.cast("double")) + 1e-6)
    root = F.when(root * root * root > n, root - 1).otherwise(root)
    return e.select("event_id", F.round(F.log2(F.abs(value) + 1e-300), 6).alias("log2_size"), (value < 0).alias("negative"), root.cast("bigint").alias("root"))


ORACLES["float_fields"] = """WITH v AS (SELECT event_id, (event_id * 2654435761) & 4294967295 AS v FROM events), f AS (SELECT event_id, v, CASE WHEN v >> 31 = 1 THEN -1 ELSE 1 END * CAST(v & 2097151 AS DOUBLE) * pow(2.0, ((v >> 21) & 1023) - 788) AS x FROM v), r AS (SELECT r FROM range(0, 200) t(r))
SELECT event_id, round(log2(abs(x) + 1e-300), 6) AS log2_size, x < 0 AS negative, (SELECT max(r) FROM r WHERE r * r * r <= (v >> 12)) AS root FROM f"""


def utf8_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number that the first bytes of each turn of a conversation code, by the number of leading ones: 1 to 4 bytes; null where there are too few."""
    t = table(spark, sf_dir, "conversations").where("octet_length(text) > 0").select("conv_id", "turn", F.col("text").cast("binary").alias("d"))
    b = [byte_at(F.col("d"), k) for k in range(4)]
    low = lambda x: x.bitwiseAND(F.lit(0x3F))
    two = F.shiftleft(b[0].bitwiseAND(F.lit(0x1F)), 6) + low(b[1])
    three = F.shiftleft(b[0].bitwiseAND(F.lit(0x0F)), 12) + F.shiftleft(low(b[1]), 6) + low(b[2])
    four = F.shiftleft(b[0].bitwiseAND(F.lit(0x07)), 18) + F.shiftleft(low(b[1]), 12) + F.shiftleft(low(b[2]), 6) + low(b[3])
    return t.select("conv_id", "turn", F.when(b[0] < 0x80, b[0]).when(b[0] < 0xE0, two).when(b[0] < 0xF0, three).otherwise(four).alias("number"))


ORACLES["utf8_numbers"] = "SELECT conv_id, turn, CAST(unicode(text) AS BIGINT) AS number FROM conversations WHERE octet_length(encode(text)) > 0"


def concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of each conversation end to end in order: where each begins, in characters, and the whole's length."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = F.coalesce(F.char_length("text"), F.lit(0))
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", (F.sum(n).over(w) - n).alias("start"), F.sum(n).over(Window.partitionBy("conv_id")).alias("length"))


ORACLES["concatenated"] = "SELECT conv_id, turn, CAST(sum(coalesce(length(text), 0)) OVER (PARTITION BY conv_id ORDER BY turn) - coalesce(length(text), 0) AS BIGINT) AS start, CAST(sum(coalesce(length(text), 0)) OVER (PARTITION BY conv_id) AS BIGINT) AS length FROM conversations"

def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id and its number spread over 32 bits."""
    return table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 2654435761).bitwiseAND(F.lit((1 << 32) - 1)).alias("v"))


def bit_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of 3, 5, 11 and 13 bits of a word, read from its highest bit down, and from its lowest up; how many bits are set, and the word's highest."""
    widths, high, low = (3, 5, 11, 13), [], []
    for k, w in enumerate(widths):
        mask = F.lit((1 << w) - 1)
        high.append(F.shiftright("v", sum(widths[k + 1 :])).bitwiseAND(mask).alias(f"high{k}"))
        low.append(F.shiftright("v", sum(widths[:k])).bitwiseAND(mask).alias(f"low{k}"))
    return spread(spark, sf_dir).select("event_id", *high, *low, F.bit_count("v").cast("bigint").alias("ones"), F.getbit("v", F.lit(31)).cast("bigint").alias("top"))


ORACLES["bit_fields"] = """WITH v AS (SELECT event_id, (event_id * 2654435761) & 4294967295 AS v FROM events)
SELECT event_id, v // 536870912 AS high0, v // 16777216 % 32 AS high1, v // 8192 % 2048 AS high2, v % 8192 AS high3, v % 8 AS low0, v // 8 % 32 AS low1, v // 256 % 2048 AS low2, v // 524288 AS low3, CAST(bit_count(v) AS BIGINT) AS ones, v // 2147483648 AS top FROM v"""


def version_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of three parts packed as major, minor and patch of 16, 8 and 8 bits, in order of the packed number, and unpacked again; by version, how many events."""
    major, minor, patch = F.pmod("event_id", F.lit(5)), F.pmod("event_id", F.lit(11)), F.pmod("event_id", F.lit(3))
    packed = F.shiftleft(major, 16).bitwiseOR(F.shiftleft(minor, 8)).bitwiseOR(patch)
    n = table(spark, sf_dir, "events").groupBy(packed.alias("packed")).agg(F.count("*").alias("n"))
    parts = [F.shiftright("packed", 16), F.shiftright("packed", 8).bitwiseAND(F.lit(255)), F.col("packed").bitwiseAND(F.lit(255))]
    return n.select("packed", F.concat_ws(".", *parts).alias("version"), "n")


ORACLES["version_numbers"] = "SELECT (event_id % 5) * 65536 + (event_id % 11) * 256 + event_id % 3 AS packed, (event_id % 5) || '.' || (event_id % 11) || '.' || (event_id % 3) AS version, count(*) AS n FROM events GROUP BY 1, 2"


def reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as 8 short windows one behind the other, put in order of bin and window, and the place that each sample came from."""
    n = F.floor(F.size("x") / 8).cast("int")
    source = lambda i: F.pmod(i, F.lit(8)) * n + F.floor(i / 8).cast("int")
    out = F.transform(F.sequence(F.lit(0), 8 * n - 1), lambda i: F.struct(source(i).cast("bigint").alias("source"), F.get("x", source(i)).alias("x")))
    f = frames(spark, sf_dir).where(F.size("x") >= 8).select("frame_no", F.posexplode(out).alias("i", "s"))
    return f.select("frame_no", F.col("i").cast("bigint").alias("i"), "s.source", F.round("s.x", 6).alias("x"))


ORACLES["reordered"] = f"""WITH {FRAMES_SQL}, n AS (SELECT frame_no, count(*) // 8 AS n FROM f GROUP BY 1)
SELECT frame_no, i % n * 8 + i // n AS i, i AS source, round(x, 6) AS x FROM f JOIN n USING (frame_no) WHERE i < 8 * n"""


def nearest_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry of an ascending table, here of the squares to 22 * 22, nearest to each event's whole value; of two as near the lower. By entry, how many and how far."""
    entries = F.array(*[F.lit(k * k) for k in range(23)])
    v = F.round("value").cast("int")
    above = F.least(F.ceil(F.sqrt(F.greatest(v, F.lit(0)).cast("double"))).cast("int"), F.lit(22))
    high, low = F.get(entries, above), F.get(entries, F.greatest(above - 1, F.lit(0)))
    near = F.when(v - low <= high - v, low).otherwise(high)
    e = table(spark, sf_dir, "events").where("value is not null").select(near.cast("bigint").alias("entry"), F.abs(v - near).cast("bigint").alias("off"))
    return e.groupBy("entry").agg(F.count("*").alias("n"), F.sum("off").alias("off"))


ORACLES["nearest_entry"] = """WITH e AS (SELECT event_id, CAST(round(value) AS BIGINT) AS v FROM events WHERE value IS NOT NULL), n AS (SELECT v, k * k AS entry, abs(v - k * k) AS off FROM e, range(0, 23) t(k) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(v - k * k), k) = 1)
SELECT entry, count(*) AS n, CAST(sum(off) AS BIGINT) AS off FROM n GROUP BY 1"""

# What the codes in a lossless frame's header stand for; 0 means as the stream says.
BLOCK_CODES = [(1, 192), (2, 576), (3, 1152), (4, 2304), (5, 4608), (8, 256), (9, 512), (10, 1024), (11, 2048), (12, 4096), (13, 8192), (14, 16384), (15, 32768)]
RATE_CODES = [(1, 88200), (2, 176400), (3, 192000), (4, 8000), (5, 16000), (6, 22050), (7, 24000), (8, 32000), (9, 44100), (10, 48000), (11, 96000)]
DEPTH_CODES = [(1, 8), (2, 12), (4, 16), (5, 20), (6, 24)]


def frame_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of a lossless frame's header in bytes 3 and 4 of each turn of a conversation, looked up in tables: samples of a block, rate, channels, bits; null for
    codes that stand for no fixed value."""
    t = table(spark, sf_dir, "conversations").where("octet_length(text) >= 4").select("conv_id", "turn", F.col("text").cast("binary").alias("d"))
    two, three = byte_at(F.col("d"), 2), byte_at(F.col("d"), 3)
    mode = F.shiftright(three, 4)
    t = t.select("conv_id", "turn", F.shiftright(two, 4).alias("b"), two.bitwiseAND(F.lit(15)).alias("r"), F.shiftright(three, 1).bitwiseAND(F.lit(7)).alias("p"), F.when(mode <= 7, mode + 1).when(mode <= 10, 2).alias("channels"))
    for code, name, pairs_ in (("b", "block", BLOCK_CODES), ("r", "rate", RATE_CODES), ("p", "bits", DEPTH_CODES)):
        t = t.join(F.broadcast(spark.createDataFrame(pairs_, f"{code} bigint, {name} bigint")), code, "left")
    return t.select("conv_id", "turn", "block", "rate", "channels", "bits")


def _case(code: str, pairs_: list[tuple[int, int]]) -> str:
    return f"CASE {code} " + " ".join(f"WHEN {k} THEN {v}" for k, v in pairs_) + " END"


ORACLES["frame_heads"] = f"""WITH h AS (SELECT conv_id, turn, hex(encode(text)) AS h FROM conversations WHERE octet_length(encode(text)) >= 4), b AS (SELECT conv_id, turn, CAST('0x' || substr(h, 5, 2) AS BIGINT) AS x, CAST('0x' || substr(h, 7, 2) AS BIGINT) AS y FROM h)
SELECT conv_id, turn, CAST({_case('x // 16', BLOCK_CODES)} AS BIGINT) AS block, CAST({_case('x % 16', RATE_CODES)} AS BIGINT) AS rate, CASE WHEN y // 16 <= 7 THEN y // 16 + 1 WHEN y // 16 <= 10 THEN 2 END AS channels, CAST({_case('y // 2 % 8', DEPTH_CODES)} AS BIGINT) AS bits FROM b"""

QUERIES = {f.__name__: f for f in (bit_fields, version_numbers, reordered, nearest_entry, frame_heads, edit_list, last_block, channel_map, first_stream, leading_samples, stream_totals, raw_samples, text_checksums, stream_info, packet_heads, float_fields, utf8_numbers, concatenated)}
