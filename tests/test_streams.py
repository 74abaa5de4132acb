"""Streams in several batches, with rows late and out of order, give what one batch in order gives."""

import os
import random
import tempfile

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.compare import connect, rows
from wavecrest.plans import catalogue
from wavecrest.streaming.ordered import LookAhead, Reservoir, chained, run_through
from wavecrest.streaming.recovery import losses, recovered

SF = "/root/testdata/sf0.001"


def in_batches(spark, hours):
    """The events in four files, each a batch; an event is up to so many hours late."""
    place, r = tempfile.mkdtemp(prefix="spark-"), random.Random(4)
    events = pq.read_table(f"{SF}/events.parquet")
    at = [t.timestamp() + r.uniform(0, 3600 * hours) for t in events["ts"].to_pylist()]
    order = sorted(range(len(at)), key=at.__getitem__)
    for k in range(4):
        pq.write_table(events.take(order[k * len(at) // 4 : (k + 1) * len(at) // 4]), f"{place}/events{k}.parquet")
        os.utime(f"{place}/events{k}.parquet", (1e9 + k, 1e9 + k))
    s = spark.readStream.schema(spark.read.parquet(place).schema).option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", 1).parquet(place)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


@pytest.mark.parametrize("query", ["stream_all_blocks", "stream_history", "stream_recovered"])
def test_batches_do_not_matter(spark, query):
    place = tempfile.mkdtemp(prefix="spark-")
    make = {"stream_all_blocks": lambda e: chained(e, LookAhead()), "stream_history": lambda e: chained(e, Reservoir()), "stream_recovered": lambda e: recovered(*losses(e))}[query]
    got = run_through(spark, make, in_batches(spark, 20), place)
    if query == "stream_all_blocks":
        got = got.select("channel", "block", "n", F.round("energy", 4).alias("energy"), (F.col("n") == 8).alias("full"))
    want = connect(SF).execute(catalogue.ORACLES[query]).df()
    assert rows(got.toPandas()) == rows(want)
    assert len([f for f in os.listdir(f"{place}/checkpoint/commits") if f.isdigit()]) >= 5


def test_every_kind_of_gap_is_met():
    found = connect("/root/testdata/sf0.01").execute(catalogue.ORACLES["stream_recovered"]).df()
    assert (found["recovered"] == 0).any() and (found["concealed"] == 0).any() and ((found["recovered"] > 0) & (found["concealed"] > 0)).any()
