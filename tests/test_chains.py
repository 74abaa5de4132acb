"""Chains over ranges against plain loops, on channels of many ranges and with one channel of a third of all rows and more."""

import random

import pytest
from pyspark.sql import functions as F

from wavecrest.operators import scan
from wavecrest.plans import chains


def channel_rows(seed):
    r = random.Random(seed)
    rows = []
    for channel, n in ((1, 1), (2, 31), (3, 32), (4, 33), (5, 1100), (6, 5000), (None, 70)):
        level = 1.0
        for i in range(n):
            level = r.choice([level, level, level, 40.0, 1.0]) if i % 3 == 0 else level
            rows.append((channel, i, round(r.uniform(-level, level), 3)))
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def signal(spark):
    rows = channel_rows(5)
    return rows, spark.createDataFrame(rows, "channel bigint, i bigint, x double").repartition(5)


def by_channel(rows):
    out = {}
    for channel, i, x in sorted(rows, key=lambda r: r[1]):
        out.setdefault(channel, []).append(x)
    return out


def plain_sequence(x, part, floor):
    """Frame by frame, block by block, as a loop."""
    size = 8 * part
    flags, prev, base = [], 0.0, 0.0
    for at in range(0, len(x), size):
        attack, position = False, 0
        for w in range(8):
            e = 0.0
            for v in x[at + w * part : min(at + (w + 1) * part, at + size)]:
                e += (v - prev) ** 2
                prev = v
            if not attack and e > 8 * base and e > floor:
                attack, position = True, w
            base = 0.7 * base + 0.3 * e if base > e else e
        flags.append((attack, position))
    quiet, out, was = (False, 0), [], False
    for j in range(len(flags) + 1):
        (a0, p0), (a1, p1), (a2, _) = (flags[k] if 0 <= k < len(flags) else quiet for k in (j - 1, j, j + 1))
        short = a0 or a1
        soon = a1 or a2
        bridged = not short and was and soon
        short = short or bridged
        kind = "short" if short else "start" if soon else "stop" if was else "long"
        sizes = []
        if short:
            s = min(p1 + 4, 7) if a1 else max(p0 - 4, 0) if a0 else 0
            sizes = [n for n in (s, min(2, 8 - s), 8 - s - min(2, 8 - s)) if n > 0]
        out.append((j, kind, bridged, "+".join(map(str, sizes))))
        was = short
    return out


def test_window_sequence_of_long_channels(signal):
    rows, frame = signal
    got = {}
    for r in chains.sequence(chains.attacks(frame, 2, 50.0)).collect():
        got.setdefault(r.channel, []).append((r.frame, r.sequence, r.bridged, r.groups))
    want = {c: plain_sequence(x, 2, 50.0) for c, x in by_channel(rows).items()}
    assert {c: sorted(v) for c, v in got.items()} == want
    kinds = {(k, b) for v in want.values() for _, k, b, _ in v}
    assert {("long", False), ("start", False), ("short", False), ("stop", False), ("short", True)} <= kinds


def test_held_peaks_of_long_channels(signal):
    rows, frame = signal
    got = {(r.channel, r.i): r.held for r in chains.held_peaks(frame, 0.8).collect()}
    n = 0
    for channel, x in by_channel(rows).items():
        y = 0.0
        for i, v in enumerate(x):
            y = max(abs(v), 0.8 * y)
            assert got[channel, i] == pytest.approx(y, abs=1e-9)
            n += 1
    assert n == len(got) == len(rows)


@pytest.mark.parametrize("width", [2, 7, 32])
def test_counter_of_three_states(signal, width):
    rows, frame = signal
    step = F.when(F.col("x") > 0, F.array(F.lit(1), F.lit(2), F.lit(0))).otherwise(F.array(F.lit(0), F.lit(0), F.lit(2)))
    got = scan.states_before(frame.withColumn("step", step), ["channel"], "i", "step", scan.table_compose, scan.table_apply, F.lit(0), width=width)
    got = {(r.channel, r.i): (r.state, r.x) for r in got.collect()}
    for channel, x in by_channel(rows).items():
        state = 0
        for i, v in enumerate(x):
            assert got[channel, i] == (state, v)
            state = (1, 2, 0)[state] if v > 0 else (0, 0, 2)[state]
    assert len(got) == len(rows)


def test_no_task_holds_a_channel(signal):
    """The largest group of the tree is a range."""
    _, frame = signal
    plan = chains.held_peaks(frame, 0.8)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning(channel#" in plan and ", __up#" in plan


def test_empty(spark):
    none = spark.createDataFrame([], "channel bigint, i bigint, x double")
    assert chains.held_peaks(none, 0.8).collect() == [] and chains.sequence(chains.attacks(none, 2, 1.0)).collect() == []
