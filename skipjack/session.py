"""Session factory used by tests and the benchmark."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Python workers find this package: local ones where it lies, those of a cluster in an archive that Spark sends them once."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    context.environment.setdefault("PYTHONPATH", ROOT)
    if not context.master.startswith("local["):
        folder = tempfile.mkdtemp(prefix="skipjack-")
        atexit.register(shutil.rmtree, folder, True)  # executors fetch the archive from the driver as long as it runs
        context.addPyFile(shutil.make_archive(f"{folder}/skipjack-package", "zip", ROOT, "skipjack"))


def importable(query):
    """Wrap f(spark, ...) so that the session's workers can import this package."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args):
        ship(spark)
        return query(spark, *args)

    return run


def get_session(app: str = "skipjack", cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with UTC time, AQE and Arrow; on a cluster pass your own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
