"""Sending this package to the workers of a session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import tarkash

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes the package importable in the session's Python workers, once an application.

    The driver serves the archive; nothing needs to be installed where the workers run.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(tarkash.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "tarkash.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
