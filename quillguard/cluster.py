"""Makes this package importable in the Python workers of a cluster."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
_KEPT: list[tempfile.TemporaryDirectory] = []


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once for an application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.TemporaryDirectory()  # the driver serves the file from there; it goes with the process
    _KEPT.append(folder)
    target = Path(folder.name) / f"{root.name}-{sc.applicationId}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*")):
            if p.suffix in (".py", ".json"):
                z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)
