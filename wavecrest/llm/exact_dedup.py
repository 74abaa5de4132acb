"""Exact dedup by a tree of sorted digest runs, in DataFrame functions only.

Each partition of the scan is a run: its texts' digests, sorted, equal ones folded into one entry that holds the best row and a count. In round k
the runs whose numbers agree but for their k lowest digits (base ``fan_in``) exchange entries and are merged; every merge sorts and keeps, of
entries that are verified to be equal, the one whose row stays. After the last round there is one run, dealt over all partitions by digest. What
was decided there goes down the same tree, to the entries of the runs that hold a repeated text, and at last to the rows.

An entry is told by the SHA-256 of the normalised text, verified at every level by the text's length in bytes and a second, independent hash:
entries that differ in any of them are never merged.

Scale: texts are read once and never shuffled. A digest has at most ``fan_in`` entries to merge in a group at any level, and on the way down a join's key is
(run, digest), so a text that a third of all rows hold is spread over as many groups as there are runs. Rounds grow with the logarithm of the number
of partitions; the way down carries only texts that are there twice. Each level is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavecrest.llm.shared import cut, drop

ENTRY = ["digest", "size", "check"]
BLANKS = " \n\t\r\x0b\f"


def without_blanks(text: Column) -> Column:
    """text without ASCII white space; one search for each character costs half of a regular expression."""
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def merged(entries: DataFrame) -> DataFrame:
    """Entries of (run, digest, size, check) with their best row and count. The aggregate of a struct runs on sorted rows, on both sides of the
    exchange, so runs arrive sorted and leave merged and sorted."""
    return entries.groupBy("run", *ENTRY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """Returns one row per row of docs: id_col, keep_id (id of the row that stays), group_size (rows of that text), kept, text_sha256 (lower-case
    hex digest of the normalised text in UTF-8).

    Texts are equal if they are identical without their ASCII white space; a null text counts as empty. Of equal texts the row of the
    most code points stays, then that of the smallest id, a null id being larger than any other; of rows that agree in all of that, one. So each
    text has exactly one row with kept, and rows that repeat an id are rows of their own. keep_id is null if the row that stays has no id. An empty
    table gives an empty result; other columns are ignored."""
    if fan_in < 2 or fan_in & (fan_in - 1):
        raise ValueError("fan_in must be a power of two")
    bits = fan_in.bit_length() - 1
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), text.alias("text"))
    rows = rows.select("row", "id", F.char_length("text").alias("chars"), without_blanks(F.col("text")).alias("plain"))
    rows = rows.select("row", "id", "chars", F.unhex(F.sha2("plain", 256)).alias("digest"), F.octet_length("plain").alias("size"), F.xxhash64("plain").alias("check"))
    rows = cut(rows.withColumn("run", F.shiftright("row", 33)))

    best = F.struct((-F.col("chars")).alias("chars"), F.col("id").isNull().alias("none"), "id", "row")
    levels = [cut(merged(rows.select("run", *ENTRY, best.alias("best"), F.lit(1).cast("bigint").alias("n"))))]
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    while runs > 1:
        levels.append(cut(merged(levels[-1].withColumn("run", F.shiftright("run", bits)))))
        runs = -(-runs // fan_in)

    # what was decided for texts that are there twice, from the last run down to the first ones
    verdict = levels.pop().where("n > 1")
    for level in reversed(levels):
        above = verdict.withColumnRenamed("run", "above")
        verdict = cut(level.select("run", *ENTRY, F.shiftright("run", bits).alias("above")).join(above, ["above", *ENTRY]).drop("above"))
    out = rows.join(verdict.select("run", *ENTRY, F.col("best.id").alias("keep"), F.col("best.row").alias("keep_row"), "n"), ["run", *ENTRY], "left")
    drop(*levels)
    single = F.col("n").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(single, F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        (single | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
