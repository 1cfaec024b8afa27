"""Send this package to the executors, for queries whose tasks run Python."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Zip the package and add it to the session's files, once for each application."""
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    folder, name = os.path.split(PACKAGE)
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix=f'{name}-')}/{name}", "zip", folder, name)
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(application)
