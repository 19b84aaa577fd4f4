"""Queries run where executors don't find the package by themselves."""

import os
import subprocess
import sys
from pathlib import Path

CODE = """
import sys; sys.path.insert(0, {home!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
print("rows", entry.queries()["rate_limit"](spark, "/root/testdata/sf0.001").count())
"""


def test_shipped_package(tmp_path):
    home = str(Path(__file__).resolve().parent.parent)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", CODE.format(home=home)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert "rows " in done.stdout, done.stderr[-2000:]
