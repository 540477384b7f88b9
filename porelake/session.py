"""Session helpers: local sessions for tests and benches, and this package's code for executors that don't have it."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine with adaptive execution, UTC and Arrow."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("porelake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that their Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_porelake_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="porelake-code-")
    try:
        staged = os.path.join(folder, "staged")
        shutil.copytree(here, os.path.join(staged, "porelake"), ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(os.path.join(folder, "porelake"), "zip", staged))
    finally:
        shutil.rmtree(os.path.join(folder, "staged"), ignore_errors=True)
    context._porelake_shipped = True
