"""A place that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """A new path below the folder that the session names in spark.checkpoint.dir; a local one only where that is unset and all tasks run in the
    driver's own process, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="spark-"))
        base = _own[0]
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"
