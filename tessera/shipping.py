"""Bring the package to the executors of a cluster that doesn't have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def packed(path: str) -> str:
    """The package's modules as a zip file at path."""
    root = os.path.dirname(os.path.abspath(__file__))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                out.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), os.path.dirname(root)))
    return path


def ship(spark: SparkSession) -> None:
    """Have each executor import the package from a file that Spark sends it; once a session, before the first query."""
    spark.sparkContext.addPyFile(packed(os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera.zip")))
