"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line is the set of its tokens, ordered by rarity. Two sets of sizes n and m with Jaccard similarity t or more share a token
among the first n - ceil(t n) + 1 of the one and m - ceil(t m) + 1 of the other (prefix filter), have t n <= m <= n / t (length
filter), and have enough tokens left behind the shared one (positional filter). Two words of 64 parities of each set add a sound bound:
every bit in which they differ stands for a token that only one of the sets has. What passes is confirmed on the whole sets.

Scale: equal sets are folded into their first line before anything is joined, with a partial aggregate. Rarity is read from a table of
``BUCKETS`` summed counts, of fixed size whatever the text, so no join back to all tokens is needed; any order gives exact results, and a good
one only fewer candidates. Prefixes are exchanged once and joined with themselves by a semi-join on token and size class (a line is in the class
of its size, and in the next if it can match a line there): a line stops at the first one that passes the filters, so of a group of thousands of alike lines each is a row a token at most, and no table of pairs is made. The lines that pass are fetched
whole and tried against one candidate each, twice; those that match neither go through a last semi-join whose condition compares the whole sets.
Lists of lines and texts are joined by sorting, whatever their size, so that a plan that is right for some lines is the plan for all. Tables
that nothing reads any more are dropped.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavecrest.llm.shared import column_name, cut, drop, maybe_in

BLANKS = " \t\x0b\x0c\r"
BUCKETS = 1 << 18
#: A token's number: 7 bits of rarity (a character code), 56 bits of hash.
HASH = (1 << 56) - 1
#: So often an open line is tried against a single one, before those left are against all.
ROUNDS = 2


def plain(text: Column) -> Column:
    """Lower case, with spaces for the other blanks, so that tokens lie between spaces and line feeds."""
    lower = out = F.lower(text)
    for blank in BLANKS[1:]:
        out = F.replace(out, F.lit(blank), F.lit(" "))
    return F.when(reduce(Column.__or__, (text.contains(blank) for blank in BLANKS[1:])), out).otherwise(lower)


def hashed(tokens: Column) -> Column:
    """The distinct hashes of tokens but the empty one."""

    def h(t: Column) -> Column:
        return F.xxhash64(t).bitwiseAND(F.lit(HASH))

    return F.array_remove(F.array_distinct(F.transform(tokens, h)), h(F.lit("")))


def rarity_table(docs: DataFrame) -> bytes:
    """One character, A to Z and on, for each bucket of token hashes: its count of tokens in ``text``, in quarter powers of two. Counts up to twice
    the median are all A, since there a bucket's count says nothing of the one token. At most half of the buckets are collected."""
    one_line = F.replace(plain(F.col("text")), F.lit("\n"), F.lit(" "))
    words = docs.select(F.explode(F.split(one_line, " ")).alias("t")).where("t <> ''")
    counts = cut(words.groupBy(F.xxhash64("t").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("b")).agg(F.count("*").alias("n")))
    noise = 2 * (counts.agg(F.median("n")).first()[0] or 0)
    table = bytearray(b"A" * BUCKETS)
    for b, quarters in counts.where(F.col("n") > noise).select("b", F.floor(4 * F.log2(F.col("n") / noise))).collect():
        table[b] = 66 + min(60, quarters)
    drop(counts)
    return bytes(table)


def by_rarity(hashes: Column, table: bytes) -> Column:
    """Hashes with their rarity before them, rarest first."""
    ranks = F.split(F.lit(",".join(map(str, table))), ",").cast("array<tinyint>")  # a constant to Spark

    def ranked(x: Column) -> Column:
        rank = F.coalesce(ranks[x.bitwiseAND(F.lit(BUCKETS - 1))].cast("bigint"), F.lit(0).cast("bigint"))
        return F.shiftleft(rank, 56).bitwiseOR(x)

    return F.sort_array(F.transform(hashes, ranked))


def parity(hashes: Column) -> Column:
    """A word: in each bit, whether the number of hashes that fall there is odd."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), x.bitwiseAND(F.lit(63)).cast("int"))
    return F.reduce(hashes, F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseXOR(bit(x)))


def parted(sets: DataFrame, hashes: str, n: int, name: str) -> DataFrame:
    """sets with a column of arrays: the hashes in n equal ranges. They are put in order with the ranges' ends among them, a column each step, so
    that each is computed once; arrays that can't hold nulls are sorted as plain numbers."""
    ends = [F.lit((HASH + 1) // n * k).cast("bigint") for k in range(1, n)]
    out = sets.withColumn("order", F.sort_array(F.concat(hashes, F.array(*ends))))
    out = out.withColumn("places", F.array(F.lit(0), *(F.array_position("order", x).cast("int") for x in ends), F.size("order") + 1))
    place = lambda k: F.get("places", F.lit(k))
    return out.withColumn(name, F.array(*(F.slice("order", place(k) + 1, place(k + 1) - place(k) - 1) for k in range(n)))).drop("order", "places")


def needed(n: Column, m: Column, t: float) -> Column:
    """The least number of shared tokens of sets of n and m with similarity t."""
    return F.ceil((n + m) * t / (1 + t) - 1e-9)


#: Words of parities of all sets, and of those that may match another, for which two of a large set tell too little.
COARSE = ["map1", "map2"]
FINE = [f"fine{k}" for k in range(8)]


def may_match(a: str, b: str, t: float, words: list[str] = COARSE) -> Column:
    """Length, positional and parity filters for the sets whose columns begin with a and b: n holds the size, pos the place of the shared token."""
    n, m = (F.col(f"{x}n") for x in (a, b))
    p, q = (F.col(f"{x}pos") for x in (a, b))
    least = needed(n, m, t)
    differ = reduce(Column.__add__, (F.bit_count(F.col(f"{a}{w}").bitwiseXOR(F.col(f"{b}{w}"))) for w in words))
    # what follows from the last of the others, and tells most pairs apart, comes first
    soon = differ <= (n + m) * ((1 - t) / (1 + t)) + 1e-6
    return soon & (F.least(n, m) >= F.greatest(n, m) * t - 1e-9) & (F.least(n - p, m - q) >= least) & (differ <= n + m - 2 * least)


def prefixed(sets: DataFrame, table: bytes, t: float, fine: bool = False) -> DataFrame:
    """doc, line, set, n, the words of ``COARSE``, those of ``FINE`` if asked for, key (a hash of the set) and prefix of sets (doc, line, set)."""
    n = F.col("n")
    out = parted(sets.withColumn("n", F.size("set")), "set", 2, "halves")
    out = (parted(out, "set", len(FINE), "eighths") if fine else out).withColumn("s", by_rarity(F.col("set"), table))
    # of a set that only an equal one can match nothing is joined
    alone = (F.floor(n / t + 1e-9) == n) & (F.ceil(n * t - 1e-9) == n)
    prefix = F.slice("s", 1, F.when(alone, 0).otherwise(n - F.ceil(n * t - 1e-9) + 1).cast("int"))
    # a token is told by 32 bits of its hash: a chance meeting is one more candidate
    prefix = F.transform(prefix, lambda x: (x.bitwiseAND(F.lit((1 << 32) - 1)) - (1 << 31)).cast("int"))
    words = [parity(F.get("halves", F.lit(k))).alias(w) for k, w in enumerate(COARSE)]
    words += [parity(F.get("eighths", F.lit(k))).alias(w) for k, w in enumerate(FINE)] if fine else []
    return out.select("doc", "line", "set", "n", *words, F.xxhash64("s").alias("key"), prefix.alias("prefix"))


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc, line and set (hashes) of the lines named in wanted (doc, line)."""
    listed = wanted.groupBy("doc").agg(F.collect_set("line").alias("lines"))
    rows = docs.join(listed.hint("merge"), "doc").select("doc", "lines", F.split(plain(F.col("text")), "\n").alias("all"))
    rows = rows.select("doc", F.inline(F.transform("lines", lambda i: F.struct(i.alias("line"), F.get("all", i).alias("one")))))
    return rows.where("one is not null").select("doc", "line", hashed(F.split("one", " ")).alias("set"))


def whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``sets_of`` where only texts that may hold a line of wanted are shuffled."""
    needed_docs = maybe_in(wanted.select(F.xxhash64("doc").alias("key")))
    return sets_of(docs.where(needed_docs(F.xxhash64("doc"))), wanted)


def confirmed(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """(doc, line) of the later lines of pairs (fdoc, fline, doc, line) that are similar indeed, by their whole sets."""
    x = pairs.join(sets.select("doc", "line", F.col("set").alias("y")).hint("merge"), ["doc", "line"])
    x = x.join(sets.select(F.col("doc").alias("fdoc"), F.col("line").alias("fline"), F.col("set").alias("x")).hint("merge"), ["fdoc", "fline"])
    return cut(x.where(similar("x", "y", t)).select("doc", "line").distinct())


def size_classes(n: Column, t: float) -> Column:
    """The class of a set's size and that of the largest size it can match: of two sets that match, the smaller is in the larger one's class too.
    A class is wider than what sizes of a match can differ by, so these are one class or two that follow each other."""
    width = math.log(max(3, 2 / t))
    kind = lambda x: F.floor(F.log(x) / width).cast("int")
    return F.array_distinct(F.array(kind(n), kind(F.floor(n / t + 1e-9))))


def postings(sets: DataFrame, t: float, *more: str) -> DataFrame:
    """A row per size class and token of the prefix: doc, line, n, further columns, pos, tok (of both); in this order a self-join's sides have like
    plans. Numbers have a value where a table's schema can't say so, and a join's condition then asks for none."""
    known = [F.coalesce(c, F.lit(0).cast(kind)).alias(c) if kind in ("int", "bigint") else c for c, kind in sets.select("doc", "line", "n", *more).dtypes]
    rows = sets.select(*known, "prefix", F.explode(size_classes(F.col("n"), t)).alias("class"))
    rows = rows.select("doc", "line", "n", *more, "class", F.posexplode("prefix").alias("pos", "tok"))
    return rows.select("doc", "line", "n", *more, "pos", F.hash("class", "tok").alias("tok"))


def meet(rows: DataFrame, others: DataFrame, condition: Column) -> DataFrame:
    """(doc, line) of the rows (alias l) that meet one of others (alias f) with a token and condition in common. Each row is one at most."""
    there = (F.col("l.tok") == F.col("f.tok")) & condition
    return rows.alias("l").join(others.alias("f").hint("merge"), there, "left_semi").select("doc", "line").distinct()


def earlier(a: str, b: str) -> Column:
    """Whether the line of prefix a comes before that of prefix b."""
    return (F.col(f"{a}doc") < F.col(f"{b}doc")) | ((F.col(f"{a}doc") == F.col(f"{b}doc")) & (F.col(f"{a}line") < F.col(f"{b}line")))


def similar(x: str, y: str, t: float) -> Column:
    """Whether the sets x and y have similarity t."""
    common = F.size(F.array_intersect(x, y))
    return common >= (F.size(x) + F.size(y) - common) * t - 1e-9


def standing_lines(docs: DataFrame, threshold: float) -> DataFrame:
    """doc and kept (the numbers of its lines that no earlier line matches, blank ones aside) of docs (doc, text); documents without such
    lines have no row."""
    t, c = threshold, F.col
    known = docs.where("doc is not null and text is not null")
    table = rarity_table(known)

    lines = known.select("doc", F.posexplode(F.split(plain(c("text")), "\n")).alias("line", "one")).where(F.btrim("one") != "")
    lines = prefixed(lines.select("doc", "line", hashed(F.split("one", " ")).alias("set")), table, t)
    first = F.struct("doc", "line", "n", *COARSE, "prefix")
    same = ["key", *COARSE]  # of equal sets; others have one of three words of 64 bits that differs
    sets = cut(lines.select(*same, first.alias("r")).groupBy(*same).agg(F.min("r").alias("r")).select("r.*"))

    # the lines that may match any other; both sides of the join read one exchange
    posts = postings(sets, t, *COARSE)
    alike = cut(meet(posts, posts, may_match("l.", "f.", t) & (earlier("f.", "l.") | earlier("l.", "f."))))
    near = cut(prefixed(whole_sets(known, alike), table, t, fine=True).drop("key"))
    drop(alike)

    # each open line against one: of those that were chosen for none before, the first for most of its tokens
    ends = ["fdoc", "fline", "doc", "line"]
    names = ["doc", "line", "n", *COARSE, "pos"]
    nearest = F.max_by(F.struct("fdoc", "fline"), F.struct("k", F.bitwise_not("fdoc"), F.bitwise_not("fline"))).alias("f")
    lost, tried, still, others = [], [], near, near
    for _ in range(ROUNDS):
        firsts = postings(others, t, *COARSE).groupBy(c("tok").alias("ftok")).agg(F.min(F.struct(*names)).alias("f")).select("ftok", *(c(f"f.{x}").alias(f"f{x}") for x in names))
        met = postings(still, t, *COARSE).join(firsts.hint("merge"), (c("tok") == c("ftok")) & earlier("f", "") & may_match("", "f", t))
        met = met.groupBy(*ends).agg(F.count("*").alias("k")).groupBy("doc", "line").agg(nearest)
        tried.append(cut(met.select("f.fdoc", "f.fline", "doc", "line")))
        lost.append(confirmed(tried[-1], near, t))
        still = still.join(lost[-1].hint("merge"), ["doc", "line"], "left_anti")
        others = others.join(tried[-1].select(c("fdoc").alias("doc"), c("fline").alias("line")).distinct().hint("merge"), ["doc", "line"], "left_anti")
    drop(*tried)

    # what is open still against all earlier ones; whole sets go beside the tokens only of lines that may match so
    left = still.select("doc", "line", F.lit(True).alias("open")).hint("merge")
    marked = lambda rows: rows.join(left, ["doc", "line"], "left").withColumn("open", c("open").isNotNull())
    posts = postings(marked(near.drop("set")), t, "open", *FINE)
    later = F.when(earlier("f.", "l."), c("l.open")).when(earlier("l.", "f."), c("f.open"))
    alike = cut(meet(posts, posts, may_match("l.", "f.", t, FINE) & later))
    posts = postings(marked(near.join(alike.hint("merge"), ["doc", "line"])), t, "open", *COARSE, "set")
    lost.append(cut(meet(posts.where("open"), posts, may_match("l.", "f.", t) & earlier("f.", "l.") & similar("l.set", "f.set", t))))
    drop(near, alike)

    gone = reduce(DataFrame.unionAll, lost).groupBy("doc").agg(F.collect_set("line").alias("gone"))
    first = sets.groupBy("doc").agg(F.collect_set("line").alias("first")).join(gone.hint("merge"), "doc", "left")
    return first.select("doc", F.array_except("first", F.coalesce("gone", F.array().cast("array<int>"))).alias("kept")).where(F.size("kept") > 0)


def numbers(lines: Column, full: bool) -> Column:
    """The numbers of the lines that hold a token, or of those that don't."""
    blank = lambda i: F.ltrim(F.get(lines, i), F.lit(BLANKS)) == ""
    return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: ~blank(i) if full else blank(i))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """Returns id_col, n_lines, and removed (array of int, ascending): the numbers, from 0, of the lines that an earlier line matches.

    Lines are what lies between line feeds. A line's set is its distinct lower-cased tokens between ASCII white space; two lines match if the
    Jaccard similarity of their sets is at least ``threshold``. Lines are in order of id, then number. A line is removed if any earlier line
    matches it, whether that one is removed itself or not; so of a chain of matches only its first line stays. Blank lines match nothing.

    One row per row of docs. Null texts have 0 lines. Rows with a null id keep all lines and remove none. Rows that repeat an id count as one
    document: where one of them keeps a line number, all do. An empty table gives an empty result. Other columns are ignored."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    kept = standing_lines(docs, threshold).withColumnRenamed("doc", "k")
    shapes = docs.select("doc", F.split("text", "\n").alias("lines")).select("doc", F.size("lines").alias("n"), numbers(F.col("lines"), True).alias("full"))
    out = shapes.join(kept, F.col("doc") == F.col("k"), "left")
    none = F.array().cast("array<int>")
    removed = F.when(F.col("full").isNull() | F.col("doc").isNull(), none).otherwise(F.array_except("full", F.coalesce("kept", none)))
    return out.select(F.col("doc").alias(id_col), F.coalesce("n", F.lit(0)).alias("n_lines"), removed.alias("removed"))


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """docs with the lines of ``removed_lines`` taken out of its texts, without the documents that have lost all their lines that
    aren't blank. Documents that had none, null texts and rows with a null id stay as they are; so do all other columns."""
    known = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    key, kept, lines = (column_name(docs, x) for x in ("__key", "__kept", "__lines"))
    standing = standing_lines(known, threshold).withColumnsRenamed({"doc": key, "kept": kept})
    out = docs.join(standing, F.col(id_col).cast("bigint") == F.col(key), "left").withColumn(lines, F.split(text_col, "\n"))
    whole = F.col(text_col).isNull() | F.col(id_col).isNull()
    has_lines = F.btrim(F.col(text_col), F.lit(BLANKS + "\n")) != ""
    out = out.where(whole | ~has_lines | F.col(kept).isNotNull())
    stay = F.array_sort(F.array_union(numbers(F.col(lines), False), F.col(kept)))
    text = F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), "\n")
    return out.withColumn(text_col, F.when(whole | ~has_lines, F.col(text_col)).otherwise(text)).select(*docs.columns)
