"""Python workers import this package; where it isn't installed, it is sent to them."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add the package to the session's files for workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        package = Path(__file__).resolve().parents[1]
        at = os.path.realpath(tempfile.mkdtemp(prefix="commweave-"))
        spark.sparkContext.addPyFile(shutil.make_archive(f"{at}/commweave-{app}", "zip", package.parent, package.name))
        _sent.add(app)
    return spark
