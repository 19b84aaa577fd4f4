"""Folders of a session's own for files that are written and read again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_folders: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share.

    It lies in ``spark.checkpoint.dir``; only a local master may go without
    that setting, and then takes the machine's temporary folder. The folder
    goes when the driver ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not base:
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}"
    path = f"{base.rstrip('/')}/tallgrass-{name}-{uuid.uuid4().hex}"
    if not _folders:
        atexit.register(_sweep)
    _folders.append((spark, path))
    return path


def _sweep() -> None:
    for spark, path in _folders:
        if spark.sparkContext._jsc is not None:  # not stopped yet
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
