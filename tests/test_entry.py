import importlib.util

import __spark_entry__


def test_entry(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.columns == ["frame_no", "bits", "snr_db", "failed", "rank"] and frame.count() > 0


def test_names():
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(found) and len(found) >= 59
    if importlib.util.find_spec("wavecrest.llm"):
        assert {f"op{k}" for k in range(1, 14)} <= {n.partition("_")[0] for n in found} and "pipeline" in found
