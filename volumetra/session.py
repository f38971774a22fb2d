"""A session with the settings that the queries count on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def session(master: str = "local[8]", partitions: int = 8, **more: str) -> SparkSession:
    """UTC timestamps, adaptive execution, Arrow; partitions fits a test machine and should be raised on a cluster."""
    b = SparkSession.builder.master(master).appName("volumetra")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | more
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; where that is unset, a temporary one on a local master (tests) alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        made = tempfile.mkdtemp(prefix="volumetra-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        root = f"file://{made}"
    return f"{root}/{name}-{uuid.uuid4().hex}"
