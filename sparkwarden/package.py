"""The package for executors that do not have it installed."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once in an application: Spark serves the archive from the driver."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="sparkwarden-")  # the driver's own: executors fetch the archive through Spark
    try:
        sc.addPyFile(shutil.make_archive(os.path.join(folder, "sparkwarden"), "zip", os.path.dirname(root), os.path.basename(root)))
    finally:
        # local masters read the file where it is until the application ends
        import atexit

        atexit.register(shutil.rmtree, folder, True)
    _sent.add(sc.applicationId)
