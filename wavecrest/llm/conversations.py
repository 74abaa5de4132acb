"""Conversation structure repair by a suffix-shared automaton.

A conversation's rows become a signature of one letter per row: what its role may stand for in the grammar ``(s?(ua)+)?``, and its fault. Signatures
are cut into blocks of ``BLOCK`` rows. The blocks of all conversations are sorted by what follows them and then from their ends, so that
blocks which share an ending are neighbours: the automaton of all of them, minimised from the end, is walked with one stack, and each of its nodes is
met once in a task. A node holds, for each of the four grammar states, the cost to go and the best suffix of the audit; it follows from the node behind it alone. In a state each
edit leads to one place, so of equally cheap edits the first letter decides.

Scale: rows are numbered by ranges of turns, later copies found by an aggregate joined back, and blocks are groups of bounded size. The sort of blocks spreads equal signatures over
tasks by a hash behind them. The cost to go of conversations of several blocks is carried from block to block, four numbers at a time; texts are shuffled
once and streamed in order past the audit, since a digest of a whole conversation is sequential: a task holds one row and one audit, however long the conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavecrest.llm.shared import cut, drop
from wavecrest.operators.ranks import numbered

BLANKS = " \t\n\x0b\f\r"
BLOCK = 64
#: Grammar states: 0 nothing yet, 1 behind a system turn, 2 behind a user turn, 3 behind an assistant turn. Where a user or assistant turn that is made leads to.
MADE = (2, 2, 3, 2)
#: Where a turn that is kept leads to, by state.
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "x": (None,) * 4}
ROLES = {2: "user", 3: "assistant"}
LEGAL = {"su", "ua", "au"}
RETELL, DELETE, INSERT, MEND = 3, 4, 3, 3
DIGEST = "conv string, illegal bigint, cost bigint, audit string, repaired_sha256 string"
TURNS = "conv string, place bigint, edit string, role string, text string"

#: A node: cost to go, audit and the state at its end, for each grammar state.
Node = tuple[tuple[int, ...], tuple[str, ...], tuple[int, ...]]
LAST: Node = ((0, 2 * INSERT, INSERT, 0), ("", "II", "I", ""), (0, 3, 3, 3))


def before(node: Node, letter: str) -> Node:
    """The node of a row of that letter in front of a node: lower case as it is, upper case truncated, d if it must be deleted."""
    costs, audits, ends = node
    best = []
    for state in range(4):
        options = [(DELETE + costs[state], "D" + audits[state], ends[state])]
        if letter != "d":
            mend = MEND if letter.isupper() else 0
            kept, made = KEPT[letter.lower()][state], MADE[state]
            if kept is not None:
                options.append((mend + costs[kept], "K" + audits[kept], ends[kept]))
            options.append((RETELL + mend + costs[made], "R" + audits[made], ends[made]))
        best.append(min(options))
    # turns that are inserted before the row: never two from states 2 and 3, which would lead back
    out = list(best)
    for state in (2, 3, 0, 1):
        cost, audit, end = (best if state in (2, 3) else out)[MADE[state]]
        out[state] = min(best[state], (INSERT + cost, "I" + audit, end))
    return tuple(o[0] for o in out), tuple(o[1] for o in out), tuple(o[2] for o in out)


def open_end(costs: tuple[int, ...]) -> Node:
    """What lies behind a block that others follow."""
    return costs, ("",) * 4, (0, 1, 2, 3)


def damaged(table: DataFrame) -> DataFrame:
    """conv, turn, role, text after the damage that a row's hash names: dropped, emptied, without its full stops, repeated, or said by the user."""
    or_space = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(or_space(F.col("conv_id")), F.lit(":"), or_space(F.col("turn"))).cast("binary")) % 20
    rows = table.select(or_space(F.col("conv_id")).alias("conv"), F.col("turn").cast("bigint").alias("turn"), or_space(F.col("role")).alias("role"), or_space(F.col("text")).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    rows = rows.where("kind <> 0").select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


def signature(initial: Column, must_go: Column, truncated: Column) -> Column:
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return F.when(must_go, "d").when(truncated, F.upper(known)).otherwise(known)


def faults(rows: DataFrame) -> DataFrame:
    """conv, turn, pos (from 0, in order), fault (blank, duplicate, truncated or null) and letter of rows (conv, turn, role, text)."""
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    heads = rows.select("conv", "turn", "role", F.xxhash64("role", "text").alias("k1"), F.xxhash64(F.lit(1), "role", "text").alias("k2"), end.alias("end"))
    heads = cut(numbered(heads, ["conv"], F.floor(F.col("turn") / 4096), ["turn", "role", "k1", "k2"], "pos"))
    again = heads.groupBy(F.col("conv").alias("c"), F.col("k1").alias("h1"), F.col("k2").alias("h2")).agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    told = heads.join(again, (F.col("conv") == F.col("c")) & (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")), "left")
    fault = F.when(F.col("end") == "", "blank").when(F.col("pos") > F.col("first"), "duplicate").when(~F.col("end").isin(".", "!", "?"), "truncated")
    told = told.select("conv", "turn", "pos", fault.alias("fault"), F.substring("role", 1, 1).alias("initial"))
    is_gone = F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False))
    letter = signature(F.col("initial"), is_gone, F.coalesce(F.col("fault") == "truncated", F.lit(False)))
    out = cut(told.select("conv", "turn", "pos", "fault", letter.alias("letter")))
    drop(heads)
    return out


def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (conv, block, letters), a conversation's in order from its last one, with the costs to go behind each."""
    conv, costs = None, LAST[0]
    for batch in batches:
        behind, last = [], []
        for c, letters in zip(batch.column("conv").to_pylist(), batch.column("letters").to_pylist(), strict=True):
            last.append(c != conv)
            conv, costs = (c, LAST[0]) if c != conv else (conv, costs)
            behind.append(costs)
            node = open_end(costs) if not last[-1] else LAST
            for letter in reversed(letters):
                # the audits aren't wanted here, and don't grow
                node = open_end(before(node, letter)[0])
            costs = node[0]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(behind, pa.list_(pa.int64())), pa.array(last)], ["conv", "block", "letters", "behind", "last"])


BLOCKS = "conv string, block bigint, letters string, behind array<bigint>, last boolean"
PLANS = "conv string, block bigint, costs array<bigint>, audits array<string>, ends array<int>"


def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs to go, audits and end states of blocks, which come in order of (last, behind, reversed letters): a node for each letter of the last block
    is kept, and those of the ending that the next one shares with it serve again."""
    start, path, nodes = None, "", []
    for batch in batches:
        out = []
        for last, behind, rest in zip(*(batch.column(c).to_pylist() for c in ("last", "behind", "reversed")), strict=True):
            if (last, behind) != start:
                start, path, nodes = (last, behind), "", [LAST if last else open_end(tuple(behind))]
            same = 0
            while same < min(len(path), len(rest)) and path[same] == rest[same]:
                same += 1
            del nodes[same + 1 :]
            for letter in rest[same:]:
                nodes.append(before(nodes[-1], letter))
            path = rest
            out.append(nodes[-1])
        columns = [pa.array([list(o[k]) for o in out], pa.list_(kind)) for k, kind in enumerate((pa.int64(), pa.string(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("block"), *columns], ["conv", "block", "costs", "audits", "ends"])


def plans(heads: DataFrame) -> DataFrame:
    """conv, block, and for each grammar state before the block costs, audits and ends, from rows (conv, pos, letter)."""
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "letter"))), lambda x: x["letter"]), "")
    blocks = cut(heads.groupBy("conv", F.floor(F.col("pos") / BLOCK).alias("block")).agg(letters.alias("letters")))
    long = blocks.where("block = 1").select("conv")
    last = F.array(*[F.lit(c).cast("bigint") for c in LAST[0]])
    single = blocks.join(long, "conv", "left_anti").select("*", last.alias("behind"), F.lit(True).alias("last"))
    several = blocks.join(long, "conv", "left_semi").select("conv", "block", "letters").repartition("conv").sortWithinPartitions("conv", F.desc("block")).mapInArrow(carried, BLOCKS)
    both = cut(single.unionByName(several).withColumn("reversed", F.reverse("letters")))
    order = ["last", "behind", "reversed"]
    out = cut(both.repartitionByRange(*order, F.xxhash64("conv")).sortWithinPartitions(*order).select("conv", "block", *order).mapInArrow(planned, PLANS))
    drop(blocks, both)
    return out


class Walk:
    """One conversation at a time: plans of its blocks, then its rows in order."""

    def __init__(self, conv: str):
        self.conv, self.audit, self.state, self.cost = conv, [], 0, None
        self.letters, self.at, self.now, self.illegal, self.initial = None, 0, 0, 0, None

    def plan(self, costs: list[int], audits: list[str], ends: list[int]) -> None:
        self.cost = costs[0] if self.cost is None else self.cost
        self.audit.append(audits[self.state])
        self.state = ends[self.state]

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        self.letters = "".join(self.audit) if self.letters is None else self.letters
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            self.at += 1
            self.now = MADE[self.now]
            yield "I", ROLES[self.now], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """Edits and turns that stand for a row: what is inserted before it, then itself. A deleted turn is told as well."""
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in LEGAL
        self.initial = initial
        yield from self.inserted()
        edit = self.letters[self.at]
        self.at += 1
        if edit == "R":
            self.now = MADE[self.now]
            role = ROLES[self.now]
        elif edit == "K":
            self.now = KEPT[initial][self.now]
        yield edit, role, text


def streamed(batches: Iterator[pa.RecordBatch], tell) -> Iterator[tuple]:
    """What ``tell`` makes of each turn of each conversation and then, with None for the turn, of its end."""
    walk = None
    for batch in batches:
        for conv, kind, costs, audits, ends, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "kind", "costs", "audits", "ends", "role", "text")), strict=True):
            if walk is None or conv != walk.conv:
                if walk is not None:
                    yield from (tell(walk, turn) for turn in (*walk.inserted(), None))
                walk = Walk(conv)
            if kind == 0:
                walk.plan(costs, audits, ends)
            else:
                yield from (tell(walk, turn) for turn in walk.row(role, text))
    if walk is not None:
        yield from (tell(walk, turn) for turn in (*walk.inserted(), None))


def batched(rows: Iterator[tuple | None], names: list[str], types: list[pa.DataType], size: int = 2048) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        if row is not None:
            held.append(row)
            if len(held) == size:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
                held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def tell(walk: Walk, turn: tuple | None) -> tuple | None:
        if turn is not None:
            edit, role, text = turn
            if edit != "D":
                if not hasattr(walk, "hash"):
                    walk.hash = hashlib.sha256()
                else:
                    walk.hash.update(b"\n")
                walk.hash.update(f"{role}:{text}".encode())
            return None
        return walk.conv, walk.illegal, walk.cost, walk.letters, getattr(walk, "hash", hashlib.sha256()).hexdigest()

    yield from batched(streamed(batches, tell), ["conv", "illegal", "cost", "audit", "repaired_sha256"], [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()])


def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def tell(walk: Walk, turn: tuple | None) -> tuple | None:
        if turn is None or turn[0] == "D":
            return None
        walk.place = getattr(walk, "place", -1) + 1
        return walk.conv, walk.place, *turn

    yield from batched(streamed(batches, tell), ["conv", "place", "edit", "role", "text"], [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()])


def in_order(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The plans of a conversation's blocks, then its rows in the order of ``faults``; the one exchange of texts."""
    texts = rows.select("conv", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("block"), F.lit(None).cast("array<bigint>").alias("costs"), F.lit(None).cast("array<string>").alias("audits"), F.lit(None).cast("array<int>").alias("ends"), "turn", "role", "text")
    heads = plan.select("conv", F.lit(0).alias("kind"), "block", "costs", "audits", "ends", F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    both = heads.unionByName(texts).repartition("conv")
    order = ["conv", "kind", "block", "turn", "role", F.xxhash64("role", "text"), F.xxhash64(F.lit(1), "role", "text")]
    return both.sortWithinPartitions(*order).select("conv", "kind", "costs", "audits", "ends", "role", "text")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv, place (from 0), edit (K kept, R told by another role, I inserted), role and text of the turns of repaired conversations, from rows (conv,
    turn, role, text) without nulls in conv, role and text. Conversations that lose all turns have none."""
    return in_order(rows, plans(faults(rows))).mapInArrow(turns, TURNS)


def repair_conversations(table: DataFrame) -> DataFrame:
    """Damages table (conv_id, turn, role, text) and repairs it. Returns one row per conv_id, null included: conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256.

    Rows of a conversation are in order of turn, nulls first; rows of one turn in order of role, then of a hash of role and text, so
    copies are adjacent. A null role or text is one space, and so is a null conv_id or turn in the damage's key. Faults: blank (no character but
    ASCII white space), duplicate (role and text of an earlier row), truncated (last such character no ``.``, ``!`` or ``?``); the first of
    them counts. A role stands for its first letter; one without letters fits nowhere. Edits: keep (0), retell as user or assistant (3), delete (4; needed if blank or duplicate), insert an empty turn of
    user or assistant (3), and 3 for each truncated row that isn't deleted. The audit is the cheapest edits' letters (K, R, D, I) after which
    the roles' letters read ``(s?(ua)+)?``; of equally cheap ones the least in ASCII. A conversation without rows after damage has zeros, an empty audit and the digest of
    an empty text. Repeated rows are copies of each other. An empty table gives an empty result; other columns are ignored."""
    rows = damaged(table)
    heads = faults(rows)
    told = in_order(rows, plans(heads)).mapInArrow(digests, DIGEST)
    count = lambda kind: F.count_if(F.coalesce(F.col("fault") == kind, F.lit(False)))
    gap = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    stats = heads.groupBy("conv").agg(gap.alias("gaps"), *(count(k).alias(k) for k in ("blank", "duplicate", "truncated")))
    every = table.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv")).distinct()
    out = every.join(stats, "conv", "left").join(told, "conv", "left")
    none = F.lit(hashlib.sha256().hexdigest())
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    kind = table.schema["conv_id"].dataType
    conv = F.when(F.col("conv") != " ", F.col("conv").cast(kind)).alias("conv_id")
    return out.select(conv, *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", none).alias("repaired_sha256"))
