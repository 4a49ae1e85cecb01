"""Make this package importable in the Python workers of any cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


BATCH_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Send a zip of the package's modules to the executors, once a context.

    Also bounds what a Python worker holds at once: unless the session has set
    that itself, Arrow batches have at most ``BATCH_ROWS`` rows.
    """
    if not spark._jsparkSession.sessionState().conf().contains(_ROWS):
        spark.conf.set(_ROWS, str(BATCH_ROWS))
    context = spark.sparkContext
    if getattr(context, "_gleaner_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    where = os.path.join(tempfile.mkdtemp(prefix="gleaner-"), "gleaner.zip")
    with zipfile.ZipFile(where, "w") as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("gleaner", os.path.relpath(path, top)))
    context.addPyFile(where)
    context._gleaner_shipped = True
