"""Folders for what a query writes and reads again."""

from __future__ import annotations

import re
from uuid import uuid4

from pyspark.sql import SparkSession

#: Where spark.checkpoint.dir is unset and all executors are on this machine, as in tests.
LOCAL_DIR = "file:///tmp/checkpoints/quillgrid"


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; an error where it is unset and the master isn't local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or LOCAL_DIR).rstrip('/')}/{name}-{uuid4().hex}"
