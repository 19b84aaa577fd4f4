"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form
#: feed and carriage return (Java's ``\s`` is exactly this set).
WORD = "[^\\x20\\x09-\\x0D]+"
SPACE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors share.

    ``spark.checkpoint.dir`` where the cluster sets it, else a folder beside
    the warehouse unless that is a path of each machine's own; only a local
    master may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        path = "file://" + os.path.join(tempfile.gettempdir(), f"tallgrass-{os.getpid()}")
    else:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if warehouse.startswith(("file:", "/")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = warehouse.rstrip("/") + "/_tallgrass_work"
    return path


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the DataFrame doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Workspace:
    """Tables written to the shared folder to cut lineage.

    ``save`` writes a DataFrame as Parquet and reads it back, so that a lost
    executor costs a re-read and not a recomputation. ``drop`` removes saved
    tables that no later plan reads. What a lazy result still reads stays
    until the driver ends, which removes the workspaces of its session.
    """

    _roots: list[tuple[SparkSession, str]] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tallgrass-{uuid.uuid4().hex}"
        self._count = 0

    def save(self, df: DataFrame, compression: str = "snappy") -> DataFrame:
        if not self._count:
            if not Workspace._roots:
                atexit.register(Workspace._sweep)
            Workspace._roots.append((self.spark, self.root))
        self._count += 1
        path = f"{self.root}/{self._count}"
        df.write.option("compression", compression).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tallgrass_path = path
        return out

    def drop(self, *saved: DataFrame) -> None:
        for df in saved:
            _delete(self.spark, df._tallgrass_path)

    @classmethod
    def _sweep(cls) -> None:
        for spark, root in cls._roots:
            if spark.sparkContext._jsc is not None:  # not stopped yet
                _delete(spark, root)
            elif root.startswith(("file:", "/")):
                shutil.rmtree(root.removeprefix("file://"), ignore_errors=True)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def saved_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a saved (file-backed) table."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def bounded_broadcast(df: DataFrame, limit: int) -> DataFrame:
    """Hint a broadcast only where the file-backed size is within the limit."""
    return F.broadcast(df) if saved_bytes(df) <= limit else df
