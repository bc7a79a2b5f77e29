"""Sends this package to the Python workers, so that functions which refer to it run wherever the driver was started."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the application, once."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="graphsieve-ship-")) / "graphsieve.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"graphsieve/{f.relative_to(root)}")
    context.addPyFile(str(path))
    _sent.add(context.applicationId)
