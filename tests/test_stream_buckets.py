"""Chains of many channels in a bucket of the state: against plain loops and SQL, with few calls to the state."""

import hashlib
import random
import tempfile

import duckdb
import pandas as pd
import pyarrow as pa
import pytest

from tests.compare import connect, rows
from wavecrest.plans import catalogue
from wavecrest.streaming import ordered
from wavecrest.streaming.ordered import DAY, HOUR, REST, LookAhead, Reservoir, pack, unpacked


class Handle:
    """A bucket's state in memory, that counts the calls."""

    def __init__(self):
        self.calls, self.timers, self.values = 0, set(), {}

    def state(self, name, *_):
        return State(self, self.values.setdefault(name, {}))

    getMapState = getValueState = state

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


class State:
    def __init__(self, handle, held):
        self.handle, self.held = handle, held

    def __getattribute__(self, name):
        if name not in ("handle", "held", "__class__"):
            self.handle.calls += 1
        return object.__getattribute__(self, name)

    def exists(self):
        return bool(self.held)

    def keys(self):
        return iter(list(self.held))

    def getValue(self, key):
        return self.held[key]

    def updateValue(self, key, value):
        self.held[key] = value

    def removeKey(self, key):
        del self.held[key]

    def get(self):
        return self.held[0]

    def update(self, value):
        self.held[0] = value

    def clear(self):
        self.held.clear()


class Watermark:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


def run(processor, events, batches, delay=DAY):
    """What comes out of a bucket; events (channel, at, event_id, value, payload) in so many batches. Also the handle."""
    processor.init(handle := Handle())
    out, now = [], 0

    def expire():
        while due := sorted(t for t in handle.timers if t < now):
            out.extend(processor.handleExpiredTimer((3,), Watermark(now), None))
            handle.timers.discard(due[0])

    for k in range(batches):
        part = events[k * len(events) // batches : (k + 1) * len(events) // batches]
        table = pa.table({
            "bucket": [3] * len(part), "channel": [e[0] for e in part], "at": [e[1] for e in part], "event_id": [e[2] for e in part],
            "value": [e[3] or 0.0 for e in part], "there": [e[3] is not None for e in part], "payload": pa.array([e[4] for e in part], pa.binary()),
        }).select(["bucket", "channel", "at", "event_id", *processor.columns])
        frames = [pd.DataFrame({"bucket": [3], "rows": b["rows"].to_pylist()}) for b in pack(iter(table.to_batches(max_chunksize=100)))]
        assert list(processor.handleInputRows((3,), iter(frames), Watermark(now))) == []
        now = max(now, max(e[1] for e in part) // 1000 - delay) if part else now
        expire()
    now = 100 * REST
    expire()
    assert not handle.timers and not handle.values["held"] and not handle.values["states"]
    return pd.concat(out, ignore_index=True).astype(object), handle


def some_events(seed, n, null=0.0):
    """In order of time but for half a day; channel 1 has a third; several in a microsecond or in a millisecond."""
    r = random.Random(seed)
    events = [(1 if r.random() < 1 / 3 else r.randrange(2, 60), r.randrange(20 * DAY) * 1000 + r.randrange(3), i, None if r.random() < null else r.uniform(0, 9), None if r.random() < null else b"%d;" % r.randrange(10**6)) for i in range(n)]
    events += [(e[0], e[1] + d, n + 2 * i + d, e[3], e[4]) for i, e in enumerate(events[:30]) for d in (0, 1)]
    return sorted(events, key=lambda e: e[1] + r.uniform(0, DAY * 400))


def by_channel(events):
    out = {}
    for e in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        out.setdefault(e[0], []).append(e)
    return out


def energy(block):
    e = None
    for v in block:
        e = e if v is None else (e or 0.0) + v * v
    return e


def plain(v):
    return None if pd.isna(v) else v


@pytest.mark.parametrize("most", [300, 1 << 17])
@pytest.mark.parametrize("batches", [1, 7])
def test_blocks_against_a_loop(monkeypatch, most, batches):
    monkeypatch.setattr(ordered, "MOST", most)
    events = some_events(1, 3000, null=0.3)
    got, _ = run(LookAhead(), events, batches)
    want = []
    for channel, es in by_channel(events).items():
        blocks = [[e[3] for e in es[i : i + 8]] for i in range(0, len(es), 8)]
        for k, b in enumerate(blocks):
            want.append((channel, k, len(b), energy(b), energy(blocks[k + 1]) if k + 1 < len(blocks) else None))
    assert sorted((tuple(map(plain, r)) for r in got[["channel", "block", "n", "energy", "next_energy"]].itertuples(index=False)), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("most", [300, 1 << 17])
@pytest.mark.parametrize("batches", [1, 7])
def test_frames_against_a_loop(monkeypatch, most, batches):
    monkeypatch.setattr(ordered, "MOST", most)
    events = some_events(2, 3000, null=0.1)
    got, _ = run(Reservoir(), events, batches)
    want = []
    for channel, es in by_channel(events).items():
        store = b""
        for _, _, i, _, data in es:
            back = (i * 2654435761 & 0xFFFFFFFF) >> 23
            body = store[len(store) - back :] + data if data is not None and back <= len(store) else None
            want.append((channel, i, back, None if body is None else len(body), 0 if body is None else 1152, None if body is None else hashlib.md5(body).hexdigest()))
            store = (store + (data or b""))[-511:]
    assert sorted(tuple(map(plain, r)) for r in got[["channel", "event_id", "back", "bytes", "samples", "digest"]].itertuples(index=False)) == sorted(want)


@pytest.mark.parametrize("processor", [LookAhead, Reservoir])
def test_calls_follow_days_and_not_rows(processor):
    _, few = run(processor(), some_events(3, 2000), 1)
    _, many = run(processor(), some_events(3, 20000), 1)
    assert many.calls <= few.calls + 20 < 300


def test_a_task_holds_a_day_or_so_many_rows(monkeypatch):
    monkeypatch.setattr(ordered, "MOST", 300)
    seen, step = [], LookAhead.step
    monkeypatch.setattr(LookAhead, "step", lambda self, s, who, counts, r: seen.append(len(r)) or step(self, s, who, counts, r))
    events = some_events(4, 4000)
    run(LookAhead(), events, 1)
    day = max(sum(e[1] // (1000 * DAY) == d for e in events) for d in range(21))
    assert sum(seen) == len(events) and max(seen) < 300 + day and len(seen) > 5


def test_a_part_of_a_day_waits():
    """Rows that the watermark hasn't passed stay, with a timer at the end of the first one's hour."""
    p = LookAhead()
    p.init(handle := Handle())
    table = pa.table({"bucket": [3] * 9, "channel": [1] * 9, "at": [1000 * HOUR * k for k in range(9)], "event_id": range(9), "value": [1.0] * 9, "there": [True] * 9})
    list(p.handleInputRows((3,), iter([pd.DataFrame({"rows": b["rows"].to_pylist()}) for b in pack(iter(table.to_batches()))]), None))
    assert handle.timers == {HOUR}
    assert sum(len(f) for f in p.handleExpiredTimer((3,), Watermark(3 * HOUR + 1), None)) == 0
    assert [unpacked([bytes(v[0])])["event_id"].to_pylist() for v in handle.values["held"].values()] == [[4, 5, 6, 7, 8]] and 5 * HOUR in handle.timers


@pytest.mark.parametrize("query", ["stream_all_blocks", "stream_look_ahead", "stream_history"])
def test_no_channel_and_long_channels(spark, query):
    """Events of no user are a channel, as in SQL; so are users of no events but one, and one of a third; a microsecond decides the order."""
    place = tempfile.mkdtemp(prefix="spark-")
    duckdb.sql("""SELECT event_id, CASE WHEN event_id % 50 = 7 THEN date_trunc('millisecond', ts) + INTERVAL (9 - event_id % 3) MICROSECOND ELSE ts END AS ts,
        CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 5 ELSE user_id * 1000003 END AS user_id, event_type, CASE WHEN event_id % 13 > 0 THEN value END AS value, props FROM '/root/testdata/sf0.001/events.parquet'
        UNION ALL SELECT event_id + 1000000, ts + INTERVAL (2 - event_id % 5) MICROSECOND, 5, event_type, value, props FROM '/root/testdata/sf0.001/events.parquet' WHERE event_id % 3 = 0""").write_parquet(f"{place}/events.parquet")
    want = connect(place).execute(catalogue.ORACLES[query]).df()
    got = catalogue.QUERIES[query](spark, place)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.toPandas()) == rows(want)
