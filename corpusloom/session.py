"""Makes the package known to Python workers wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once per application.

    Workers import what they run by name; they needn't share the driver's path or folder.
    """
    sc = spark.sparkContext
    if getattr(sc, "_corpusloom_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="corpusloom-"), "corpusloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("corpusloom", os.path.relpath(full, top)))
    sc.addPyFile(path)
    sc._corpusloom_shipped = True
