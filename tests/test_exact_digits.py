"""Digits that hang on the order in which numbers are added, or on how a half is rounded."""

import tempfile

import duckdb
import pytest

from tests.compare import connect, rows
from wavecrest.plans import catalogue, listings


@pytest.mark.parametrize("query", ["seek_table", "seek_points"])
def test_sums_at_a_hundred(spark, query, request):
    """A block of this channel has 99.99999999999999 in order of time, and 100 in other orders."""
    place = tempfile.mkdtemp(prefix="spark-")
    duckdb.sql("SELECT * FROM '/root/testdata/sf0.1/events.parquet' WHERE user_id = 12").write_parquet(f"{place}/events.parquet")
    want = connect(place).execute(catalogue.ORACLES[query]).df()
    for name, value in (("spark.sql.shuffle.partitions", "16"), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        before = spark.conf.get(name)
        spark.conf.set(name, value)
        request.addfinalizer(lambda name=name, before=before: spark.conf.set(name, before))
    assert rows(catalogue.QUERIES[query](spark, place).toPandas()) == rows(want)


def test_lines_round_as_sql_does(spark, monkeypatch):
    """Halves of a hundredth lie above or below in binary, or on it; what is null, negative or no number."""
    values = [s * m / 10000 for m in range(50, 20000, 100) for s in (1, -1)] + [0.0, -0.001, 0.125, -0.375, 123456.785, 1e-9, None, float("inf"), float("-inf"), float("nan")]
    gate = [(f"{i % 90}@6" if i < 300 else f"{i}@a long key, of over 18", v, v, 1.0 if v is None else -v if v == v else v, "ok") for i, v in enumerate(values)]
    gate = [(f"{i}/{k}", *v) for i, (k, *v) in enumerate(gate)] + [("none", None, None, None, "NEW")]
    frame = spark.createDataFrame(gate, "key string, d_snr double, d_nmr double, d_audible double, verdict string")
    monkeypatch.setattr(listings, "gate_by_metrics", lambda *_: frame)
    got = {r.key: r.line for r in listings.baseline_lines(spark, "").collect()}
    c = duckdb.connect()
    sql = "SELECT CASE WHEN ? = 'NEW' THEN printf('%-18s NEW (no baseline)', ?) ELSE printf('%-18s snr %+.2f nmr %+.2f aud %+.2f  %s', ?, CAST(? AS DOUBLE), CAST(? AS DOUBLE), CAST(? AS DOUBLE), ?) END"
    for key, snr, nmr, audible, verdict in gate:
        assert got[key] == c.execute(sql, [verdict, key, key, snr, nmr, audible, verdict]).fetchone()[0]
    assert len(got) == len(gate)
