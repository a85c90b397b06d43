"""This package for Python workers that cannot import it from where the driver has it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession | None = None) -> None:
    """Sends the package along as a zip file, once a context; Spark hands it to every executor. None: the active session."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="umbraframe-"), "umbraframe-package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    _SENT.add(context.applicationId)
