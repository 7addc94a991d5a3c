"""Sending this package to the executors, so that Python workers can import it wherever the driver was started."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Add the package's modules to the session's Python files, once a Spark context. Lost executors fetch them again."""
    sc = spark.sparkContext
    if getattr(sc, "_edictum_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(root):  # it runs from an archive already
        return
    path = os.path.join(tempfile.mkdtemp(prefix="edictum-"), "edictum.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("edictum", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._edictum_shipped = True
