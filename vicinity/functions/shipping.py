"""Prepares a session: sends Python workers the package, and bounds their batches and generated methods."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors once an application, as a zip file that Spark distributes."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    folder = os.path.realpath(tempfile.mkdtemp(prefix="vicinity-"))
    archive = f"{folder}/vicinity.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def small_methods(spark: SparkSession, size: int = 8000) -> None:
    """Lower the session's limit of generated methods, never raise it: the JVM never compiles one of more bytes than this."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(key)) > size:
        spark.conf.set(key, str(size))


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Lower the session's limit of rows in an Arrow batch, never raise it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= rows:
        spark.conf.set(key, str(rows))
