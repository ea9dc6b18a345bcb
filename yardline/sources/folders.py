"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_KEY = "spark.checkpoint.dir"
_LOCAL: list[str] = []


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; where that is unset (tests on one machine), under a temporary folder."""
    top = spark.conf.get(_KEY, None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_KEY} must name a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="yardline-"))
        top = _LOCAL[0]
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
