"""Makes the package importable on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once per application.

    Python functions that run on executors import it there. Where the folder
    that holds it is on PYTHONPATH or is the working folder, workers find it
    already and nothing is sent.
    """
    package = Path(__file__).resolve().parent
    home, context = str(package.parent), spark.sparkContext
    known = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if home in known or os.path.realpath(os.getcwd()) == home or context.applicationId in _shipped:
        return
    path = Path(tempfile.mkdtemp()) / "tallgrass.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)
