"""The folder that driver and executors share, for tables that a job writes between its steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``. Where that is unset (tests on one machine) a temporary folder is made and
    set; on a cluster its absence is an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="loomwork-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/loomwork/{name}-{uuid.uuid4().hex}"
