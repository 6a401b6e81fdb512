"""Python code on the workers: attach the package to the session, and stream sorted groups."""
from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that functions that run in Python
    tasks can import it there. Spark's own file distribution carries it; nothing is read from a local
    folder by an executor."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    path = os.path.join(tempfile.mkdtemp(prefix="vidimus-"), "vidimus.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(PACKAGE):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
    spark.sparkContext.addPyFile(path)
