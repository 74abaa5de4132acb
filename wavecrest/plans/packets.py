"""Packets and the headers that open a stream: framing of inner frames, fields from the low bit up, the codec of each stream, what lies behind a tag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrest.functions import signal as S
from wavecrest.operators.bridge import table
from wavecrest.sources.bits import byte_values, le_hex, low_bits
from wavecrest.sources.formats import adts_header, behind_tag, ogg_codec
from wavecrest.streaming.recovery import frame_size

ORACLES: dict[str, str] = {}

# Fixed values of packet framing: the longest frame, frames of a packet, samples of a packet (120 ms), from which byte on a length has two, what a full padding byte adds.
MOST_BYTES, MOST_FRAMES, MOST_SAMPLES, TWO_BYTES, FULL = 1275, 48, 5760, 252, 254


def length_at(b: Column, at: Column, left: Column) -> Column:
    """The length at a place of an array of bytes of which so many are left: size, used; null if it is cut off."""
    one, two = F.get(b, at.cast("int")), F.get(b, at.cast("int") + 1)
    size = F.struct(F.when(one < TWO_BYTES, one).otherwise(4 * two + one).alias("size"), F.when(one < TWO_BYTES, 1).otherwise(2).cast("bigint").alias("used"))
    return F.when((left >= 1) & ((one < TWO_BYTES) | (left >= 2)), size)


def inner_frames(packets: DataFrame) -> DataFrame:
    """packets (b: array of bytes, delimited: whether the last length is given as well, other columns) with config, samples (of a frame), refused (why a packet is malformed, or
    null), frames (array of offset and size) and taken (bytes it takes, padding included).

    The first byte tells the configuration and how many frames follow: one, two of one size, two of which the first's size is given, or a number of them with sizes given or alike, and with
    padding. Sizes that are given are read by a fold over the bytes, in the row."""
    i64 = lambda v: F.lit(v).cast("bigint")
    c = F.col
    none = F.array().cast("array<bigint>")
    p = packets.withColumns({"n": F.size("b").cast("bigint"), "toc": F.get("b", F.lit(0)), "head": F.get("b", F.lit(1))})
    p = p.withColumns({"config": F.shiftright("toc", 3), "code": c("toc").bitwiseAND(F.lit(3)).cast("int")})
    p = p.withColumn("samples", frame_size(c("config")))
    many = c("code") == 3
    full = F.array_position(F.transform(F.slice("b", 3, F.greatest(F.size("b") - 2, F.lit(0))), lambda x: x != 255), True)
    padded = many & (c("head").bitwiseAND(F.lit(0x40)) != 0)
    p = p.withColumns({"count": F.when(c("code") == 0, i64(1)).when(~many, i64(2)).otherwise(c("head").bitwiseAND(F.lit(63))), "pads": F.when(padded, full).otherwise(0)})
    p = p.withColumn("pad", F.when(c("pads") > 0, FULL * (c("pads") - 1) + F.get("b", (c("pads") + 1).cast("int"))).otherwise(0))
    p = p.withColumns({"at": F.when(many, 2 + c("pads")).otherwise(i64(1)), "vbr": (c("code") == 2) | (many & (c("head") >= 128))})
    p = p.withColumn("left", c("n") - c("at") - c("pad"))
    refused = (
        F.when(c("n") < 1, "empty")
        .when((c("code") == 1) & ~c("delimited") & (F.pmod(c("n") - 1, F.lit(2)) == 1), "odd")
        .when(many & (c("n") < 2), "count")
        .when(many & ((c("count") <= 0) | (c("count") > MOST_FRAMES) | (c("samples") * c("count") > MOST_SAMPLES)), "count")
        .when(padded & (c("pads") == 0), "padding")
        .when(c("left") < 0, "padding")
    )
    p = p.withColumn("refused", refused)

    def read(a: Column, _: Column) -> Column:
        def go(size: Column) -> Column:
            rest = a["left"] - size["used"]
            bad = a["bad"] | size.isNull() | (size["size"] > rest - a["total"])
            return F.struct((a["at"] + F.coalesce(size["used"], F.lit(0))).alias("at"), F.coalesce(rest, a["left"]).alias("left"), (a["total"] + F.coalesce(size["size"], F.lit(0))).alias("total"), F.concat(a["sizes"], F.array(F.coalesce(size["size"], F.lit(0)))).alias("sizes"), bad.alias("bad"))

        # of a list that is refused already no more is read
        return F.when(a["bad"], a).otherwise(S.let(length_at(c("b"), a["at"], a["left"]), go))

    start = F.struct(c("at").alias("at"), c("left").alias("left"), i64(0).alias("total"), none.alias("sizes"), F.lit(False).alias("bad"))
    given = F.when(c("vbr") & c("refused").isNull() & (c("count") > 1), F.sequence(i64(1), c("count") - 1)).otherwise(none)
    p = p.withColumn("r", F.reduce(given, start, read)).withColumns({"refused": F.when(c("r.bad"), "size").otherwise(c("refused")), "at": c("r.at"), "left": c("r.left"), "sizes": c("r.sizes")})
    # the length of the last frame, or of each
    p = p.withColumn("last", F.when(c("delimited") & c("refused").isNull(), length_at(c("b"), c("at"), c("left"))))
    short = c("delimited") & (c("last").isNull() | (c("last.size") > c("left") - c("last.used")))
    rest = c("left") - F.coalesce("last.used", i64(0))
    summed = F.reduce("sizes", i64(0), lambda a, x: a + x)
    over = c("delimited") & F.when(c("vbr"), c("last.size") > rest - summed).otherwise(c("last.size") * c("count") > rest)
    uneven = ~c("delimited") & ~c("vbr") & (F.pmod(c("left"), c("count")) != 0)
    p = p.withColumns({"refused": F.when(c("refused").isNotNull(), c("refused")).when(short, "last").when(over, "last").when(uneven, "uneven"), "at": c("at") + F.coalesce("last.used", i64(0)), "rest": rest})
    alike = F.when(c("delimited"), c("last.size")).otherwise(F.floor(c("left") / c("count")))
    sizes = F.when(c("vbr"), F.concat("sizes", F.array(F.when(c("delimited"), c("last.size")).otherwise(c("left") - summed)))).otherwise(F.transform(F.sequence(i64(1), c("count")), lambda _: alike))
    p = p.withColumn("sizes", F.when(c("refused").isNull(), sizes))
    p = p.withColumn("refused", F.when(F.exists("sizes", lambda x: (x < 0) | (x > MOST_BYTES)), "large").when(F.reduce("sizes", i64(0), lambda a, x: a + x) > c("rest"), "large").otherwise(c("refused")))
    # places of the frames: their number is at most 48
    places = F.reduce("sizes", F.struct(c("at").alias("at"), F.array().cast("array<struct<offset: bigint, size: bigint>>").alias("f")), lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["f"], F.array(F.struct(a["at"].alias("offset"), x.alias("size")))).alias("f")))
    p = p.withColumn("r", F.when(c("refused").isNull(), places)).withColumns({"frames": c("r.f"), "taken": c("pad") + c("r.at")})
    return p.select(*packets.columns, "config", "samples", "refused", "frames", "taken")


def text_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, packet, b: the bytes of each turn in pieces of 200, each behind two bytes that a multiplication makes of its place."""
    t = table(spark, sf_dir, "conversations").where("octet_length(text) > 0").select("conv_id", "turn", byte_values(F.col("text").cast("binary")).alias("all"))
    t = t.select("conv_id", "turn", "all", F.explode(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / 200).cast("int"))).alias("packet"))
    h = ((F.col("conv_id") * 7919 + F.col("turn") * 104729 + F.col("packet") * 1299709) * 2654435761).bitwiseAND(F.lit((1 << 32) - 1))
    head = F.array(F.shiftright(h, 24), F.shiftright(h, 16).bitwiseAND(F.lit(255)))
    return t.select("conv_id", "turn", F.col("packet").cast("bigint").alias("packet"), F.concat(head, F.slice("all", F.col("packet") * 200 + 1, 200)).alias("b"))


def packet_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each inner frame of the packets of conversations, read both as the only packet of its bytes and as one that tells its own end; of a malformed packet one row that says why."""
    p = text_packets(spark, sf_dir).withColumn("delimited", F.explode(F.array(F.lit(False), F.lit(True))))
    f = inner_frames(p).select("conv_id", "turn", "packet", "delimited", "config", "samples", "refused", "taken", F.posexplode_outer("frames").alias("frame", "f"))
    return f.select("conv_id", "turn", "packet", "delimited", "config", "samples", "refused", F.col("frame").cast("bigint").alias("frame"), "f.offset", "f.size", "taken")


ORACLES["packet_frames"] = """WITH RECURSIVE h AS (SELECT conv_id, turn, hex(encode(text)) AS h FROM conversations WHERE octet_length(encode(text)) > 0), k AS (SELECT *, unnest(range(0, (length(h) // 2 - 1) // 200 + 1)) AS packet FROM h),
v AS (SELECT conv_id, turn, packet, substr(h, 400 * packet + 1, 400) AS h, ((conv_id * 7919 + turn * 104729 + packet * 1299709) * 2654435761) & 4294967295 AS v FROM k),
b AS (SELECT conv_id, turn, packet, list_concat([v >> 24, (v >> 16) & 255], list_transform(range(0, length(h) // 2), lambda j: CAST('0x' || substr(h, 2 * j + 1, 2) AS BIGINT))) AS b FROM v),
c AS (SELECT *, len(b) AS n, b[1] >> 3 AS config, b[1] & 3 AS code, b[2] AS head FROM b), d AS (SELECT *, CAST(CASE WHEN config < 12 THEN [480, 960, 1920, 2880][config % 4 + 1] WHEN config < 16 THEN 480 * (1 + config % 2) ELSE 120 * (1 << CAST(config % 4 AS INTEGER)) END AS BIGINT) AS samples,
CASE code WHEN 0 THEN 1 WHEN 3 THEN head & 63 ELSE 2 END AS cnt, code = 3 AND head & 64 <> 0 AS padded, code = 2 OR (code = 3 AND head >= 128) AS vbr FROM c),
e AS (SELECT *, CASE WHEN padded THEN coalesce(list_position(list_transform(b[3:], lambda x: x <> 255), true), 0) ELSE 0 END AS pads FROM d), f AS (SELECT *, CASE WHEN pads > 0 THEN 254 * (pads - 1) + b[2 + pads] ELSE 0 END AS pad, CASE WHEN code = 3 THEN 2 + pads ELSE 1 END AS pos FROM e),
g AS (SELECT f.*, s.delimited, n - pos - pad AS lft, CASE WHEN code = 1 AND NOT s.delimited AND (n - 1) % 2 = 1 THEN 'odd' WHEN code = 3 AND (n < 2 OR cnt <= 0 OR cnt > 48 OR samples * cnt > 5760) THEN 'count' WHEN (padded AND pads = 0) OR n - pos - pad < 0 THEN 'padding' END AS refused FROM f CROSS JOIN (VALUES (false), (true)) s(delimited)),
r AS (SELECT conv_id, turn, packet, delimited, CAST(CASE WHEN vbr AND refused IS NULL THEN cnt - 1 ELSE 0 END AS BIGINT) AS todo, b, CAST(pos AS BIGINT) AS pos, CAST(lft AS BIGINT) AS lft, CAST([] AS BIGINT[]) AS sizes, refused FROM g UNION ALL
SELECT conv_id, turn, packet, delimited, CASE WHEN bad THEN 0 ELSE todo - 1 END, b, CASE WHEN bad THEN pos ELSE pos + used END, CASE WHEN bad THEN lft ELSE lft - used END, CASE WHEN bad THEN sizes ELSE list_append(sizes, size) END, CASE WHEN bad THEN 'size' END
FROM (SELECT *, size IS NULL OR size > lft - used - coalesce(list_sum(sizes), 0) AS bad FROM (SELECT *, CASE WHEN lft < 1 THEN NULL WHEN b[pos + 1] < 252 THEN b[pos + 1] WHEN lft >= 2 THEN 4 * b[pos + 2] + b[pos + 1] END AS size, CASE WHEN b[pos + 1] < 252 THEN 1 ELSE 2 END AS used FROM r WHERE todo > 0))),
z AS (SELECT g.conv_id, g.turn, g.packet, g.delimited, g.config, g.samples, g.cnt, g.vbr, g.pad, r.b, r.pos, r.lft, r.sizes, r.refused, CASE WHEN NOT g.delimited OR r.lft < 1 THEN NULL WHEN r.b[r.pos + 1] < 252 THEN r.b[r.pos + 1] WHEN r.lft >= 2 THEN 4 * r.b[r.pos + 2] + r.b[r.pos + 1] END AS last, CASE WHEN NOT g.delimited THEN 0 WHEN r.b[r.pos + 1] < 252 THEN 1 ELSE 2 END AS used
FROM r JOIN g USING (conv_id, turn, packet, delimited) WHERE r.todo = 0), y AS (SELECT *, lft - used AS rest, CAST(coalesce(list_sum(sizes), 0) AS BIGINT) AS total FROM z),
x AS (SELECT *, CASE WHEN refused IS NOT NULL THEN refused WHEN delimited AND (last IS NULL OR last > rest OR CASE WHEN vbr THEN last > rest - total ELSE last * cnt > rest END) THEN 'last' WHEN NOT delimited AND NOT vbr AND lft % cnt <> 0 THEN 'uneven' END AS why FROM y),
w AS (SELECT *, CASE WHEN why IS NOT NULL THEN NULL WHEN vbr THEN list_append(sizes, CASE WHEN delimited THEN last ELSE lft - total END) ELSE list_transform(range(0, cnt), lambda j: CASE WHEN delimited THEN last ELSE lft // cnt END) END AS s FROM x),
u AS (SELECT *, CASE WHEN why IS NULL AND (list_max(s) > 1275 OR list_min(s) < 0 OR list_sum(s) > rest) THEN 'large' ELSE why END AS refused2 FROM w)
SELECT conv_id, turn, packet, delimited, config, samples, refused2 AS refused, j AS frame, CAST(pos + used + coalesce(list_sum(s[1:j]), 0) AS BIGINT) AS "offset", s[j + 1] AS size, CAST(pad + pos + used + list_sum(s) AS BIGINT) AS taken FROM (SELECT *, unnest(range(0, len(s))) AS j FROM u WHERE refused2 IS NULL)
UNION ALL SELECT conv_id, turn, packet, delimited, config, samples, refused2, NULL, NULL, NULL, NULL FROM u WHERE refused2 IS NOT NULL"""


def id_fields(b: Column) -> Column:
    """The fields of an identification header that follows its 7 first bytes, each read from the low bit up: version, channels, rate, three bit rates, two block sizes, framing."""
    at, fields = 56, []
    for name, n in (("version", 32), ("channels", 8), ("rate", 32), ("most", 32), ("nominal", 32), ("least", 32), ("short", 4), ("long", 4), ("framing", 1)):
        fields.append(low_bits(b, at, n).alias(name))
        at += n
    return F.struct(*fields)


def identification(headers: DataFrame) -> DataFrame:
    """headers (b: array of bytes, other columns) with refused (why a header isn't taken, or null), channels, rate, short and long (block sizes)."""
    magic = F.array(*[F.lit(v).cast("bigint") for v in b"\x01vorbis"])
    f = headers.withColumn("f", id_fields(F.col("b"))).withColumns({"short": F.pow(S.lit(2), F.col("f.short")).cast("bigint"), "long": F.pow(S.lit(2), F.col("f.long")).cast("bigint")})
    sizes = F.col("short").between(64, 8192) & F.col("long").between(64, 8192) & (F.col("short") <= F.col("long"))
    why = (
        F.when(F.slice("b", 1, 7) != magic, "magic")
        .when(F.col("f.framing").isNull(), "short")
        .when(F.col("f.version") != 0, "version")
        .when(F.col("f.channels") < 1, "channels")
        .when(F.col("f.rate") < 1, "rate")
        .when(F.col("f.framing") != 1, "framing")
        .when(~sizes, "sizes")
    )
    good = lambda x: F.when(F.col("refused").isNull(), F.col(x))
    return f.withColumn("refused", why).select(*headers.columns, "refused", good("f.channels").alias("channels"), good("f.rate").alias("rate"), good("short").alias("short"), good("long").alias("long"))


def id_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as identification headers, some with a fault, and read back."""
    e = table(spark, sf_dir, "events").where("event_id is not null").select("event_id", (F.col("event_id") * 2654435761).bitwiseAND(F.lit((1 << 32) - 1)).alias("h"))
    part = lambda shift, mask: F.shiftright("h", shift).bitwiseAND(F.lit(mask))
    version = F.when(part(27, 31) == 0, 1).otherwise(0)
    sizes = (part(3, 3) + 6).bitwiseOR(F.shiftleft(part(5, 7) + 7, 4))
    body = [le_hex(version, 4), le_hex(part(12, 15), 1), le_hex(8000 + part(8, 65535), 4), le_hex(F.lit(-1), 4), le_hex(F.col("h"), 4), le_hex(F.lit(0), 4), le_hex(sizes, 1), le_hex(F.when(part(20, 15) == 0, 254).otherwise(1), 1)]
    data = F.concat(F.when(part(24, 31) == 1, F.lit("02")).otherwise(F.lit("01")), F.lit(b"vorbis".hex()), *body)
    data = F.when(part(16, 15) == 2, F.substring(data, 1, 56)).otherwise(data)
    return identification(e.select("event_id", byte_values(F.unhex(data)).alias("b"))).drop("b")


ORACLES["id_headers"] = """WITH h AS (SELECT event_id, (event_id * 2654435761) & 4294967295 AS h FROM events WHERE event_id IS NOT NULL),
f AS (SELECT event_id, h, CAST((h >> 12) & 15 AS BIGINT) AS channels, 8000 + ((h >> 8) & 65535) AS rate, CAST(1 << CAST(((h >> 3) & 3) + 6 AS INTEGER) AS BIGINT) AS short, CAST(1 << CAST(((h >> 5) & 7) + 7 AS INTEGER) AS BIGINT) AS long FROM h),
r AS (SELECT *, CASE WHEN (h >> 24) & 31 = 1 THEN 'magic' WHEN (h >> 16) & 15 = 2 THEN 'short' WHEN (h >> 27) & 31 = 0 THEN 'version' WHEN channels < 1 THEN 'channels' WHEN (h >> 20) & 15 = 0 THEN 'framing' WHEN long > 8192 OR short > long THEN 'sizes' END AS refused FROM f)
SELECT event_id, refused, CASE WHEN refused IS NULL THEN channels END AS channels, CASE WHEN refused IS NULL THEN rate END AS rate, CASE WHEN refused IS NULL THEN short END AS short, CASE WHEN refused IS NULL THEN long END AS long FROM r"""


def comments(headers: DataFrame) -> DataFrame:
    """headers (data: binary, other columns) with refused (magic, short or framing, or null), vendor and comments (array of texts): lengths and texts read one behind the other."""
    c = F.col
    number = lambda at: S.let(byte_values(F.substring(c("data"), at + 1, F.lit(4))), lambda b: low_bits(b, 0, 32))
    n = F.octet_length("data").cast("bigint")
    f = headers.withColumns({"size": n, "vendor_size": number(F.lit(7))})
    vendor_end = 11 + c("vendor_size")
    f = f.withColumn("count", F.when(vendor_end + 4 <= c("size"), number(vendor_end.cast("int"))))
    # a count that the bytes can't hold is cut off before anything is made of it
    f = f.withColumn("todo", F.when((c("count") > 0) & (c("count") * 4 <= c("size")), F.sequence(F.lit(1).cast("bigint"), c("count"))).otherwise(F.array().cast("array<bigint>")))
    start = F.struct((vendor_end + 4).alias("at"), F.array().cast("array<struct<at: bigint, size: bigint>>").alias("places"), F.lit(False).alias("bad"))

    def read(a: Column, _: Column) -> Column:
        def go(size: Column) -> Column:
            bad = size.isNull() | (a["at"] + 4 + size > c("size"))
            return F.struct((a["at"] + 4 + F.coalesce(size, F.lit(0))).alias("at"), F.concat(a["places"], F.array(F.struct((a["at"] + 4).alias("at"), F.coalesce(size, F.lit(0)).alias("size")))).alias("places"), (a["bad"] | bad).alias("bad"))

        return F.when(a["bad"], a).otherwise(S.let(number(a["at"].cast("int")), go))

    f = f.withColumn("r", F.reduce("todo", start, read))
    fits = c("count").isNotNull() & (c("count") * 4 <= c("size")) & ~c("r.bad") & (c("r.at") < c("size"))
    framing = S.let(byte_values(F.substring(c("data"), (c("r.at") + 1).cast("int"), F.lit(1))), lambda b: low_bits(b, 0, 1))
    why = F.when(F.substring("data", 1, 7) != F.lit(b"\x03vorbis"), "magic").when(~F.coalesce(fits, F.lit(False)), "short").when(framing != 1, "framing")
    text = lambda at, size: F.substring(c("data"), (at + 1).cast("int"), size.cast("int")).cast("string")
    f = f.withColumn("refused", why)
    return f.select(*headers.columns, "refused", F.when(c("refused").isNull(), text(F.lit(11), c("vendor_size"))).alias("vendor"), F.when(c("refused").isNull(), F.transform("r.places", lambda p: text(p["at"], p["size"]))).alias("comments"))


def comment_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as comment headers, a comment for each line, some cut off or without their last bit; the comments' keys and lengths, or why a header is refused."""
    t = table(spark, sf_dir, "conversations").where("text is not null and role is not null and conv_id is not null and turn is not null")
    sized = lambda s: F.concat(le_hex(F.octet_length(s), 4), F.hex(s.cast("binary")))
    lines = F.transform(F.split("text", "\n"), lambda x: F.concat(F.col("role"), F.lit("="), x))
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(9))
    data = F.concat(F.lit(b"\x03vorbis".hex()), sized(F.concat(F.lit("maker "), F.col("conv_id").cast("string"))), le_hex(F.size(lines), 4), F.array_join(F.transform(lines, sized), ""), F.when(kind == 1, F.lit("FE")).otherwise(F.lit("01")))
    data = F.when(kind == 2, F.substring(data, F.lit(1), F.length(data) - 2 - 2 * F.pmod("turn", F.lit(5)).cast("int"))).otherwise(data)
    f = comments(t.select("conv_id", "turn", F.unhex(data).alias("data")))
    f = f.select("conv_id", "turn", "refused", "vendor", F.posexplode_outer("comments").alias("k", "text"))
    return f.select("conv_id", "turn", "refused", "vendor", F.col("k").cast("bigint").alias("k"), F.substring_index("text", "=", 1).alias("key"), F.octet_length("text").cast("bigint").alias("bytes"), F.md5(F.col("text").cast("binary")).alias("digest"))


ORACLES["comment_headers"] = """WITH t AS (SELECT conv_id, turn, role, text, CASE WHEN (conv_id + turn) % 9 = 1 THEN 'framing' WHEN (conv_id + turn) % 9 = 2 THEN 'short' END AS refused FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL),
l AS (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS k FROM t WHERE refused IS NULL)
SELECT conv_id, turn, NULL AS refused, 'maker ' || conv_id AS vendor, k, role AS key, octet_length(encode(role || '=' || line)) AS bytes, md5(role || '=' || line) AS digest FROM l UNION ALL SELECT conv_id, turn, refused, NULL, NULL, NULL, NULL, NULL FROM t WHERE refused IS NOT NULL"""


def stream_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as streams of pages, a page a turn: the codec that the first page's first packet names, by serial; a packet may be longer than one segment of its page."""
    t = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    magic = F.when(F.pmod("conv_id", F.lit(3)) == 0, F.hex(F.lit(b"OpusHead"))).when(F.pmod("conv_id", F.lit(3)) == 1, F.hex(F.lit(b"\x01vorbis"))).otherwise(F.hex(F.lit(b"fishead")))
    packet = F.concat(magic, F.hex(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    size = (F.length(packet) / 2).cast("int")
    lacing = F.concat(F.repeat(F.lit("FF"), F.floor(size / 255).cast("int")), le_hex(F.pmod(size, F.lit(255)), 1))
    page = F.concat(F.hex(F.lit(b"OggS")), F.lit("0002"), le_hex(F.col("turn"), 8), le_hex(F.col("conv_id"), 4), le_hex(F.col("turn"), 4), le_hex(F.lit(0), 4), le_hex(F.length(lacing) / 2, 1), lacing, packet)
    first = t.select("conv_id", "turn", F.unhex(page).alias("page")).groupBy("conv_id").agg(F.min_by("page", "turn").alias("page"), F.count("*").alias("pages"))
    return first.select(F.col("conv_id").alias("serial"), "pages", ogg_codec(F.col("page")).alias("codec"))


ORACLES["stream_codecs"] = "SELECT conv_id AS serial, count(*) AS pages, CASE conv_id % 3 WHEN 0 THEN 'opus' WHEN 1 THEN 'vorbis' END AS codec FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1"


def tagged_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations behind a tag of up to 300 bytes, or none, and two bytes that may open a frame: what they are by what lies behind the tag."""
    t = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    h = (F.col("conv_id") * 31 + F.col("turn") * 7).cast("bigint")
    size = F.pmod(h, F.lit(300))
    tag = F.concat(F.hex(F.lit(b"ID3")), F.lit("030000"), *[le_hex(F.shiftright(size, 7 * k).bitwiseAND(F.lit(127)), 1) for k in (3, 2, 1, 0)], F.repeat(F.lit("00"), size.cast("int")))
    open_ = F.get(F.array(*map(F.lit, ("FFF1", "FFF9", "FFFB", "FFE3", "0000"))), F.pmod(h, F.lit(5)).cast("int"))
    data = F.concat(F.when(F.pmod(h, F.lit(2)) == 1, tag).otherwise(F.lit("")), open_, F.hex(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return t.select("conv_id", "turn", behind_tag(F.unhex(data)).alias("format"))


ORACLES["tagged_formats"] = "SELECT conv_id, turn, CASE (conv_id * 31 + turn * 7) % 5 WHEN 0 THEN 'aac' WHEN 1 THEN 'aac' WHEN 4 THEN NULL ELSE 'mp3' END AS format FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL"


def adts_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as headers of 7 bytes: rate, channels (8 for code 7, 0 for code 0) and bytes of the frame; none for another profile, a rate that isn't known, or a length below the header's."""
    e = table(spark, sf_dir, "events").where("event_id is not null").select("event_id", (F.col("event_id") * 2654435761).bitwiseAND(F.lit((1 << 32) - 1)).alias("h"))
    part = lambda shift: F.shiftright("h", shift).bitwiseAND(F.lit(255))
    second = F.when(F.pmod("event_id", F.lit(11)) == 0, 0xF3).otherwise(0xF1)
    profile = part(24).bitwiseAND(F.lit(0x3F)).bitwiseOR(F.when(F.pmod("event_id", F.lit(3)) == 0, 0x80).otherwise(0x40))
    data = F.unhex(F.concat(F.lit("FF"), le_hex(second, 1), le_hex(profile, 1), le_hex(part(16), 1), le_hex(part(8), 1), le_hex(F.col("h"), 1), F.lit("FC")))
    return e.select("event_id", adts_header(data).alias("f")).where("f is not null").select("event_id", F.col("f.sample_rate").cast("bigint").alias("rate"), F.col("f.channels").cast("bigint").alias("channels"), F.col("f.frame_bytes").cast("bigint").alias("bytes"))


ORACLES["adts_frames"] = """WITH h AS (SELECT event_id, (event_id * 2654435761) & 4294967295 AS h FROM events WHERE event_id % 11 <> 0 AND event_id % 3 <> 0), f AS (SELECT event_id, (h >> 26) & 15 AS r, ((h >> 24) & 1) * 4 + ((h >> 22) & 3) AS c, ((h >> 16) & 3) * 2048 + ((h >> 8) & 255) * 8 + ((h & 255) >> 5) AS bytes FROM h)
SELECT event_id, CAST([96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000][r + 1] AS BIGINT) AS rate, CAST(CASE WHEN c = 7 THEN 8 ELSE c END AS BIGINT) AS channels, CAST(bytes AS BIGINT) AS bytes FROM f WHERE r < 12 AND bytes >= 7"""

QUERIES = {f.__name__: f for f in (packet_frames, id_headers, comment_headers, stream_codecs, tagged_formats, adts_frames)}
