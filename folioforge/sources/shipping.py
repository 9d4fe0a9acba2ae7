"""Making this package importable in the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's files, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    if root.is_dir() and root.parent.is_dir() and not str(root).endswith(".zip"):
        target = os.path.join(tempfile.mkdtemp(prefix="folioforge-"), "folioforge.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent).as_posix())
        spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)
