"""Makes this package importable in executors that don't have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's sources to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        file = os.path.join(tempfile.mkdtemp(prefix="ship-"), "undula.zip")
        with zipfile.ZipFile(file, "w") as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, path.relative_to(root.parent))
        sc.addPyFile(file)
        _shipped.add(sc.applicationId)
    return spark
