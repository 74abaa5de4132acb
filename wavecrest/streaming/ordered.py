"""Chains on streams whose rows come late and out of order: held as map state by day until the watermark has passed them, stepped in order of time by a timer,
flushed by a timer.

Channels share buckets, and a bucket is a key of the state: its rows come, lie and are stepped as Arrow batches, so a row costs no call of Python's to the state
and a bucket has one timer at a time. What a task holds at once is a bucket's rows of some days, ``MOST`` of them or one day's, not what the delay, a batch or a
channel holds. A stream ends with a row that belongs to no channel and lies far in the future: the watermark then passes every row and every channel's time of
rest, so what is held comes out inside the stream.
"""

from __future__ import annotations

import datetime
import hashlib
import pickle
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from wavecrest.streaming.blocks import run_to_end

HOUR = 3_600_000
DAY = 24 * HOUR
#: A channel without rows for so long is at rest, and flushed.
REST = 3650 * DAY
END = datetime.datetime(2200, 1, 1)
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys of the state; the channel null has one of its own.
BUCKETS, NO_CHANNEL = 512, -1
#: Rows that are packed, laid down or stepped together.
MOST = 1 << 17


def packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def unpacked(parts: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in parts])


def numbers(rows: pa.Table, name: str) -> np.ndarray:
    return rows[name].to_numpy()


def cut(rows: pa.Table, by: np.ndarray) -> Iterator[tuple[int, pa.Table]]:
    """rows apart by a number of each, in order of the numbers; rows of the same stay in order."""
    order = np.argsort(by, kind="stable")
    rows, by = rows.take(pa.array(order)).combine_chunks(), by[order]
    starts = np.flatnonzero(np.r_[True, by[1:] != by[:-1]]) if len(by) else []
    for a, b in zip(starts, [*starts[1:], len(by)]):
        yield int(by[a]), rows.slice(a, b - a)


def gathered(parts: Iterator) -> Iterator[list]:
    """parts in lists of ``MOST`` rows together, and what a last part has more."""
    some, n = [], 0
    for p in parts:
        some.append(p)
        n += len(p)
        if n >= MOST:
            yield some
            some, n = [], 0
    if some:
        yield some


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per bucket for many: its rows as bytes."""
    for some in gathered(batches):
        rows = pa.Table.from_batches(some)
        keys, blobs = [], []
        for bucket, part in cut(rows.drop_columns("bucket"), numbers(rows, "bucket")):
            keys.append(bucket)
            blobs.append(packed(part))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "rows"])


def each(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


class InOrder(StatefulProcessor):
    """Steps states over the rows of channels (channel, at in microseconds, event_id, ``columns``) in order of time, whatever order and batch they come in. States are arrays by
    name with an element a channel; ``blank`` gives those of channels that begin. ``step`` takes states, the places of the channels that have rows, how many each has, and the
    rows, channel by channel; ``finish`` states and the places of channels at rest. Both return columns that come out, with the places in ``channel``; step changes the states."""

    columns: tuple[str, ...] = ()
    schema = "channel bigint"

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "first bigint, part bigint", "rows binary")
        self.mark = handle.getValueState("mark", "timer bigint, parts bigint")
        self.states = handle.getValueState("states", "states binary")

    def blank(self, n: int) -> dict[str, np.ndarray]:
        raise NotImplementedError

    def step(self, states: dict, who: np.ndarray, counts: np.ndarray, rows: pa.Table) -> dict:
        raise NotImplementedError

    def finish(self, states: dict, who: np.ndarray) -> dict | None:
        return None

    def waits_for(self, timer: int | None, due: list[int], parts: int) -> None:
        """One timer, at the earliest time that something is due."""
        due = min(due, default=None)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.mark.update((due, parts))

    def marked(self) -> tuple[int | None, int]:
        return tuple(self.mark.get()) if self.mark.exists() else (None, 0)

    @staticmethod
    def due(first: int) -> int:
        """The end of the hour in which a row lies."""
        return (first // 1000 // HOUR + 1) * HOUR

    def hold(self, rows: pa.Table, part: int) -> int:
        first = int(numbers(rows, "at").min())
        self.held.updateValue((first, part), (bytearray(packed(rows)),))
        return first

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        timer, parts = self.marked()
        due = [] if timer is None else [timer]
        for some in gathered((unpacked([b]) for frame in rows for b in frame["rows"])):
            table = pa.concat_tables(some)
            for _, part in cut(table, numbers(table, "at") // (1000 * DAY)):
                due.append(self.due(self.hold(part, parts)))
                parts += 1
        self.waits_for(timer, due, parts)
        return iter([])

    def ready(self, keys: list[tuple[int, int]], now: int, parts: int, left: list[int]) -> Iterator[pa.Table]:
        """The rows up to now, day by day; they are held no longer. left: gets the first of each part that stays."""
        for _, mine in groupby(keys, lambda k: k[0] // (1000 * DAY)):
            mine = list(mine)
            if mine[0][0] // 1000 > now:
                left += [first for first, _ in mine]
                continue
            rows = unpacked([bytes(self.held.getValue(k)[0]) for k in mine])
            for k in mine:
                self.held.removeKey(k)
            late = numbers(rows, "at") // 1000 > now
            if late.any():
                left.append(self.hold(rows.filter(pa.array(late)), parts))
                rows = rows.filter(pa.array(~late))
            yield rows

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        _, parts = self.marked()
        states = pickle.loads(self.states.get()[0]) if self.states.exists() else {"channel": np.empty(0, np.int64), "last": np.empty(0, np.int64)} | self.blank(0)
        left: list[int] = []
        for some in gathered(self.ready(sorted(self.held.keys()), now, parts, left)):
            rows = pa.concat_tables(some)
            rows = rows.take(pa.array(np.lexsort((numbers(rows, "event_id"), numbers(rows, "at"), numbers(rows, "channel"))))).combine_chunks()
            channels, starts, counts = np.unique(numbers(rows, "channel"), return_index=True, return_counts=True)
            states = self.joined(states, channels)
            who = np.searchsorted(states["channel"], channels)
            states["last"][who] = numbers(rows, "at")[starts + counts - 1]
            yield self.out(key, states, self.step(states, who, counts, rows))
        rest = states["last"] // 1000 + REST <= now
        if rest.any():
            out = self.finish(states, np.flatnonzero(rest))
            if out is not None:
                yield self.out(key, states, out)
            states = {k: v[~rest] for k, v in states.items()}
        due = [self.due(first) for first in left]
        if len(states["channel"]):
            due.append(int(states["last"].min()) // 1000 + REST)
            self.states.update((bytearray(pickle.dumps(states, 5)),))
        else:
            self.states.clear()
        self.waits_for(None, due, parts + 1)  # the one that has expired goes by itself

    def joined(self, states: dict, channels: np.ndarray) -> dict:
        """states with those of channels that begin; places are in order of the channels."""
        every = np.union1d(states["channel"], channels)
        if len(every) == len(states["channel"]):
            return states
        at = np.searchsorted(every, states["channel"])
        new = {"channel": every, "last": np.zeros(len(every), np.int64)} | self.blank(len(every))
        for k, v in states.items():
            if k != "channel":
                new[k][at] = v
        return new

    def out(self, key: tuple, states: dict, columns: dict) -> pd.DataFrame:
        channel = states["channel"][columns["channel"]]
        return pd.DataFrame(columns | {"channel": pd.array(channel, "Int64") if key[0] != NO_CHANNEL else pd.array([None] * len(channel), "Int64")})

    def close(self) -> None:
        pass


def optional(values: np.ndarray, known: np.ndarray) -> pd.arrays.FloatingArray:
    return pd.arrays.FloatingArray(np.asarray(values, float), ~np.asarray(known, bool))


class LookAhead(InOrder):
    """Blocks of ``size`` samples, each told when the next one is known: (block, n, energy, next energy). At rest the last block comes out without a next one,
    and a block that isn't full as well. Energies are added in order of time; samples that are null don't count, and a block of such has none."""

    size = 8
    columns = ("value", "there")
    schema = "channel bigint, block bigint, n bigint, energy double, next_energy double"

    def blank(self, n):
        # of a block that is begun: samples, which of them there are, how many; of the last full one: whether it waits, its energy
        return {
            "part": np.zeros((n, self.size)), "there": np.zeros((n, self.size), bool), "n": np.zeros(n, np.int64),
            "done": np.zeros(n, np.int64), "waits": np.zeros(n, bool), "energy": np.zeros(n), "known": np.zeros(n, bool),
        }

    def energies(self, samples: np.ndarray) -> np.ndarray:
        e = np.zeros(len(samples))
        for k in range(self.size):
            e = e + samples[:, k] * samples[:, k]
        return e

    def step(self, states, who, counts, rows):
        s, size = {k: v[who] for k, v in states.items()}, self.size
        n = s["n"] + counts
        start = np.cumsum(n) - n
        x, there = np.empty(n.sum()), np.empty(n.sum(), bool)
        begun, new = np.repeat(start, s["n"]) + each(s["n"]), np.repeat(start + s["n"], counts) + each(counts)
        filled = np.arange(size) < s["n"][:, None]
        x[begun], there[begun] = s["part"][filled], s["there"][filled]
        x[new], there[new] = numbers(rows, "value"), numbers(rows, "there")

        full = n // size
        blocks = (np.repeat(start, full) + size * each(full))[:, None] + np.arange(size)
        chain = s["waits"] + full  # the block that waits, then the new ones
        first = np.cumsum(chain) - chain
        energy, known = np.empty(chain.sum()), np.empty(chain.sum(), bool)
        energy[first[s["waits"]]], known[first[s["waits"]]] = s["energy"][s["waits"]], s["known"][s["waits"]]
        at = np.repeat(first + s["waits"], full) + each(full)
        energy[at], known[at] = self.energies(x[blocks]), there[blocks].any(axis=1)
        number, owner = np.repeat(s["done"] - s["waits"], chain) + each(chain), np.repeat(who, chain)
        some = chain > 0
        last = (first + chain - 1)[some]
        told = np.ones(len(energy), bool)
        told[last] = False
        told = np.flatnonzero(told)

        states["done"][who] += full
        states["waits"][who[some]], states["energy"][who[some]], states["known"][who[some]] = True, energy[last], known[last]
        n, start = n - full * size, start + full * size
        filled = np.arange(size) < n[:, None]
        part, there_part = np.zeros(filled.shape), np.zeros(filled.shape, bool)
        begun = np.repeat(start, n) + each(n)
        part[filled], there_part[filled] = x[begun], there[begun]
        states["part"][who], states["there"][who], states["n"][who] = part, there_part, n
        return {"channel": owner[told], "block": number[told], "n": np.full(len(told), size), "energy": optional(energy[told], known[told]), "next_energy": optional(energy[told + 1], known[told + 1])}

    def finish(self, states, who):
        s = {k: v[who] for k, v in states.items()}
        last, known = self.energies(s["part"]), s["there"].any(axis=1)
        waits, begun = s["waits"], s["n"] > 0
        full = {"channel": who[waits], "block": (s["done"] - 1)[waits], "n": np.full(waits.sum(), self.size), "energy": s["energy"][waits], "next": last[waits]}
        part = {"channel": who[begun], "block": s["done"][begun], "n": s["n"][begun], "energy": last[begun], "next": np.zeros(begun.sum())}
        both = {k: np.concatenate([full[k], part[k]]) for k in full}
        following = both.pop("next")
        both["energy"] = optional(both["energy"], np.concatenate([s["known"][waits], known[begun]]))
        return both | {"next_energy": optional(following, np.concatenate([known[waits], np.zeros(begun.sum(), bool)]))}


class Reservoir(InOrder):
    """Frames whose data begins some bytes back, in what the frames before have left: (event_id, back, bytes, samples, digest). A frame that reaches farther back than the
    ``most`` bytes that are kept, or than there are, is stored and gives no samples; so does one without data, which isn't stored."""

    most, samples = 511, 1152
    columns = ("payload",)
    schema = "channel bigint, event_id bigint, back bigint, bytes bigint, samples bigint, digest string"

    def blank(self, n):
        return {"store": np.full(n, b"", object)}

    def step(self, states, who, counts, rows):
        ids = numbers(rows, "event_id")
        backs = ((ids.astype(np.uint64) * np.uint64(2654435761)) & np.uint64(0xFFFFFFFF)) >> np.uint64(23)
        frames = zip(backs.tolist(), rows["payload"].to_pylist())
        stores, md5, most = states["store"], hashlib.md5, self.most
        sizes, digests = [], []
        for k, n in zip(who.tolist(), counts.tolist()):
            store = stores[k]
            for _, (back, data) in zip(range(n), frames):
                if data is None or back > len(store):
                    sizes.append(None)
                    digests.append(None)
                else:
                    body = store[len(store) - back :] + data
                    sizes.append(len(body))
                    digests.append(md5(body).hexdigest())
                if data is not None:
                    store = (store + data)[-most:]
            stores[k] = store
        there = np.array([d is not None for d in digests], bool)
        return {"channel": np.repeat(who, counts), "event_id": ids, "back": backs.astype(np.int64), "bytes": pd.array(sizes, "Int64"), "samples": np.where(there, self.samples, 0), "digest": digests}


def keyed(events: DataFrame, delay: str, columns: tuple[str, ...]) -> DataFrame:
    """bucket, channel, at (microseconds), event_id and those of value, there (whether it is), payload that are asked for, with the watermark of ``ts``; without the
    row that ends a stream."""
    e = events.withWatermark("ts", delay)
    every = {"value": F.coalesce("value", F.lit(0.0)), "there": F.col("value").isNotNull(), "payload": F.col("props").cast("binary")}
    bucket = F.when(F.col("user_id").isNull(), F.lit(NO_CHANNEL)).otherwise(F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS))).cast("bigint")
    # a condition on time isn't moved below the watermark, which the row that ends a stream must pass
    e = e.where(F.when(F.col("ts") < F.lit(END), F.lit(1)).isNotNull())
    return e.select(bucket.alias("bucket"), F.coalesce("user_id", F.lit(0)).alias("channel"), F.unix_micros("ts").alias("at"), "event_id", *(every[c].alias(c) for c in columns))


def chained(events: DataFrame, processor: InOrder, delay: str = "1 day") -> DataFrame:
    """What ``processor`` makes of each channel of a stream of events. Rows later than the delay by the stream's own time come behind what was stepped over."""
    rows = keyed(events, delay, processor.columns).mapInArrow(pack, "bucket bigint, rows binary")
    return rows.groupBy("bucket").transformWithStateInPandas(processor, processor.schema, "append", "eventTime")


def with_end(events: DataFrame, place: str) -> DataFrame:
    """A stream of events and of the rows in ``place``, at first none, by which it is told that the stream ends."""
    spark = events.sparkSession
    spark.createDataFrame([], events.schema).write.parquet(place)
    return events.unionByName(spark.readStream.schema(events.schema).parquet(place))


def end(spark: SparkSession, schema, place: str) -> None:
    """Tells a stream of ``with_end`` that nothing more comes."""
    spark.createDataFrame([tuple(END if f.name == "ts" else None for f in schema.fields)], schema).coalesce(1).write.mode("append").parquet(place)


def run_through(spark: SparkSession, make, events: DataFrame, place: str) -> DataFrame:
    """What the stream make(events) has given from its beginning to its end: all that is there is read, then the end, from the same checkpoint.
    State lies in RocksDB, as list state and timers ask for."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        whole = make(with_end(events, f"{place}/end"))
        run_to_end(whole, place)
        end(spark, events.schema, f"{place}/end")
        return run_to_end(whole, place)
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)
