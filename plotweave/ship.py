"""What a session needs before Python code of this package runs in its workers."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows per Arrow batch: long texts make Spark's default of 10,000 rows too large for a worker.
BATCH_ROWS = 1000


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import the package wherever they run, and bound their batches.

    The archive is built in the driver's own temporary folder and sent to the executors by
    Spark. A batch size that the user has set is left alone.
    """
    context = spark.sparkContext
    if ARROW_ROWS not in spark.conf.getAll:
        spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))
    if getattr(context, "_plotweave_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(), "plotweave"), "zip", root, "plotweave")
    context.addPyFile(archive)
    context._plotweave_shipped = True
