"""Session defaults: UTC, adaptive execution, everything else left to the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None, name: str = "brindle") -> SparkSession:
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    b = b.config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        b = b.master(master).config("spark.ui.enabled", "false")
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share; a local one only where Spark runs in one process."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        top = "file://" + tempfile.mkdtemp(prefix="brindle-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
