"""Sending this package to Python workers that run on other machines."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

#: Rows that go to a Python worker at once, so that batches of long texts stay small.
BATCH_ROWS = 1_000


@functools.cache
def _archive() -> str:
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="chatterloom-"), "chatterloom")
    return shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package))


def ship_package(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once; the driver serves the archive."""
    if os.path.basename(_archive()) not in map(os.path.basename, spark.sparkContext.listFiles):
        spark.sparkContext.addPyFile(_archive())


def limit_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to BATCH_ROWS; a worker's memory then does not grow with its partition."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
