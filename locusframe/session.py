"""Session set-up shared by the library, its tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent


def build_session(master: str = "local[*]", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session with adaptive execution, Arrow and UTC timestamps switched on."""
    builder = SparkSession.builder.master(master).appName("locusframe")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": memory,
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application, through Spark's own file server."""
    sc = spark.sparkContext
    if getattr(sc, "_locusframe_shipped", False):
        return
    handle, path = tempfile.mkstemp(prefix="locusframe-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w") as bundle:
        for source in sorted(_ROOT.rglob("*.py")):
            bundle.write(source, source.relative_to(_ROOT.parent).as_posix())
    sc.addPyFile(path)
    sc._locusframe_shipped = True
