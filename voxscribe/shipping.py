"""Sends this package to the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once a Spark application, as a zip that Spark's file server hands out, so that workers can import it wherever they start."""
    app = spark.sparkContext.applicationId
    if app in _done:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="voxscribe-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/voxscribe_code.zip", "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(f"{folder}/voxscribe_code.zip")
    _done.add(app)
